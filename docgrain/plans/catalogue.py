"""The queries of the library's operators on the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.cluster import ship
from docgrain.functions import codecs, predictors
from docgrain.functions import numbers as N
from docgrain.operators import choice, dedup, ordered, refs, sequence, stats, xmltext
from docgrain.sources import content, fonts, pdf
from docgrain.streaming import events as events_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Duplicates and references ---------------------------------------------------------------------------------------


@query("select sha256(text) as content_hash, min(doc_id) as representative, count(*) as n from documents group by 1 having count(*) > 1")
def dup_groups(spark, d):
    return dedup.content_groups(table(spark, d, "documents"), "doc_id", "text")


@query("select doc_id as duplicate, canonical from (select doc_id, min(doc_id) over (partition by sha256(text)) as canonical from documents) where doc_id <> canonical")
def dup_reference_map(spark, d):
    return dedup.reference_map(table(spark, d, "documents"), "doc_id", "text")


@query("select cast(coalesce(sum(n - 1), 0) as bigint) as duplicates from (select count(*) as n from documents group by sha256(text))")
def dup_count(spark, d):
    return dedup.duplicate_count(table(spark, d, "documents"), "doc_id", "text")


@query("with m as (select doc_id as k, min(doc_id) over (partition by sha256(text)) as c from documents) select l.doc_id, quality, toxic, coalesce(m.c, l.doc_id) as target from labels l left join m on l.doc_id = m.k")
def rewrite_references(spark, d):
    mapping = dedup.reference_map(table(spark, d, "documents"), "doc_id", "text")
    return dedup.rewrite_references(table(spark, d, "labels"), "doc_id", mapping, "target")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite_references(spark, sf_dir)


@query("select doc_id, sha256(text) as content_hash, row_number() over (partition by sha256(text) order by doc_id) > 1 as is_duplicate from documents")
def hash_listing(spark, d):
    return dedup.hash_listing(table(spark, d, "documents"), "doc_id", "text")


@query("select p_partkey, p_name from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def used_parts(spark, d):
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return refs.used(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", back, "l_partkey")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def unused_customers(spark, d):
    return refs.unused(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, d, "orders"), "o_custkey")


EDGES = """
    select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer
    union all select 's' || s_suppkey, 'n' || s_nationkey from supplier
    union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
"""


@query(f"with recursive e as ({EDGES}), w as (select src, dst, cast(1 as bigint) as depth from e union select w.src, e.dst, w.depth + 1 from w join e on w.dst = e.src where w.depth < 64) select src, dst, min(depth) as depth from w group by src, dst")
def transitive_closure(spark, d):
    edge = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    e = edge("customer", "c", "c_custkey", "n", "c_nationkey").union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))
    return refs.closure(e)


@query("select distinct l_partkey from lineitem where l_returnflag = 'R' and l_discount > 0.08")
def mask_set(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount > 0.08").select("l_partkey").distinct()


# Statistics and classes ------------------------------------------------------------------------------------------


@query("select case when event_type = 'signup' then 'heads' when event_type = 'error' then 'trailers' when value > 5 then 'with_stream' else 'without_stream' end as part, count(*) as n, round(sum(value), 4) as total from events group by 1")
def partition_counts(spark, d):
    part = stats.ladder([(F.col("event_type") == "signup", "heads"), (F.col("event_type") == "error", "trailers"), (F.col("value") > 5, "with_stream")], "without_stream")
    return table(spark, d, "events").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


LADDER = """case when text like '%!!%' then 'shout' when regexp_matches(text, '[%$#&*]{3}') then 'symbols' when text like '% | %' then 'table'
    when text like '%icense%' then 'licence' when length(text) < 200 then 'short' else 'prose' end"""


@query(f"select doc_id, {LADDER} as category from documents")
def category_ladder(spark, d):
    t = F.col("text")
    steps = [(t.contains("!!"), "shout"), (t.rlike("[%$#&*]{3}"), "symbols"), (t.contains(" | "), "table"), (t.contains("icense"), "licence"), (F.length(t) < 200, "short")]
    return table(spark, d, "documents").select("doc_id", stats.ladder(steps, "prose").alias("category"))


@query("select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as chars, count(*) filter (where n_chars >= 2000) as n_long, cast(coalesce(sum(n_chars) filter (where n_chars >= 2000), 0) as bigint) as chars_long, max(n_chars) as most from documents group by lang, source")
def document_stats(spark, d):
    return stats.counters(table(spark, d, "documents"), ["lang", "source"], "n_chars", {"long": F.col("n_chars") >= 2000}, "chars").withColumnRenamed("largest", "most")


@query("select lang, cast(sum(n_chars) as bigint) as total, cast(sum(n_chars) - sum(case when n_chars < 500 then n_chars else 0 end) - sum(case when n_chars >= 5000 then n_chars else 0 end) as bigint) as structures from documents group by lang")
def structures_residual(spark, d):
    return stats.residual(table(spark, d, "documents"), ["lang"], "n_chars", [F.col("n_chars") < 500, F.col("n_chars") >= 5000])


@query("select o_orderkey, o_totalprice, l_linenumber, l_partkey from orders left join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'P'")
def object_info_embedded(spark, d):
    parents = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return stats.with_embedded(parents, "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"])


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def upsert_last_wins(spark, d):
    return refs.last_versions(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id", "event_type", "value"])


@query("select 'type' as kind, p_type as name from part union select 'brand', p_brand from part")
def resource_distinct(spark, d):
    return stats.distinct_names(table(spark, d, "part"), {"type": "p_type", "brand": "p_brand"})


@query("select doc_id, round(entropy(c), 6) as shannon from (select doc_id, unnest(string_split(text, '')) as c from documents) group by doc_id")
def shannon_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(stats.char_entropy(F.col("text")), 6).alias("shannon"))


# Layout and naming -----------------------------------------------------------------------------------------------


@query("select doc_id, n_chars, cast(coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from documents")
def layout_offsets(spark, d):
    return ordered.prefix_sum(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", "start")


@query("with k as (select o_orderkey as key from orders where o_orderstatus = 'F'), a as (select unnest(generate_series((select min(key) from k), (select max(key) from k))) as key) select a.key, k.key is null as is_free from a left join k on a.key = k.key")
def layout_gap_fill(spark, d):
    return ordered.fill_gaps(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), "key")


@query("select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as bigint) as ordinal from lineitem")
def embedded_ordinals(spark, d):
    return stats.ordinals(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("select o_orderkey, cast(case when o_orderkey < 256 then 1 when o_orderkey < 65536 then 2 when o_orderkey < 16777216 then 3 when o_orderkey < 4294967296 then 4 else 5 end as bigint) as width, lower(lpad(printf('%x', o_orderkey), 16, '0')) as packed from orders")
def byte_width(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.byte_width(F.col("o_orderkey")).alias("width"), F.lower(F.hex(N.int_to_bytes(F.col("o_orderkey"), 8))).alias("packed"))


def part_names(spark, d) -> DataFrame:
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    return ordered.rank_by(names, {"length": F.length("name"), "start": F.substring("name", 1, 8)}, [F.col("name")], "place")


@query("select name, cast(row_number() over (order by length(name), name) - 1 as bigint) as place from (select distinct p_brand || ' ' || p_name as name from part)")
def short_first_names(spark, d):
    return part_names(spark, d)


DIGITS = f"(select '{N.BASE62}' as s)"


@query(
    "select p_partkey, case when p_partkey >= 238328 then substr(s, cast(p_partkey // 238328 % 62 as int) + 1, 1) else '' end || case when p_partkey >= 3844 then substr(s, cast(p_partkey // 3844 % 62 as int) + 1, 1) else '' end"
    f" || case when p_partkey >= 62 then substr(s, cast(p_partkey // 62 % 62 as int) + 1, 1) else '' end || substr(s, cast(p_partkey % 62 as int) + 1, 1) as short_name from part, {DIGITS}"
)
def base62_names(spark, d):
    return table(spark, d, "part").select("p_partkey", N.digits_of(F.col("p_partkey"), N.BASE62).alias("short_name"))


@query("with n as (select name, cast(row_number() over (order by length(name), name) - 1 as bigint) as place from (select distinct p_brand || ' ' || p_name as name from part)) select p_partkey, coalesce(cast(n.place as varchar), p_brand || ' ' || p_name) as new_name from part left join n on n.name = p_brand || ' ' || p_name and n.place < 100")
def translate_names(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("old"))
    return refs.translate(parts, "old", part_names(spark, d).where("place < 100"), "name", "place", "new_name").select("p_partkey", "new_name")


# Sequences -------------------------------------------------------------------------------------------------------

EVENTS = sequence.Sequence("user_id", ("ts", "event_id"))
W = "(partition by user_id order by ts, event_id)"


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")


def short(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("user_id", "event_id", *columns)


@query(f"select user_id, event_id, event_type from (select *, lead(event_type) over {W} as next from events) where next is null or next <> event_type")
def collapse_runs(spark, d):
    return short(sequence.overwritten_removed(events(spark, d), EVENTS, "event_type"), "event_type")


@query(f"select user_id, event_id, event_type from (select *, lag(event_type) over {W} as last from events) where last is null or last <> event_type")
def state_changes(spark, d):
    return short(sequence.state_changes(events(spark, d), EVENTS, "event_type"), "event_type")


@query("select user_id, event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as paid from events")
def last_value_state(spark, d):
    return short(sequence.last_value(events(spark, d), EVENTS, F.when(F.col("event_type") == "purchase", F.col("value")), "paid"), "paid")


RUNS = f"(select *, cast(sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bigint) as run from (select *, case when lag(event_type) over {W} is not distinct from event_type then 0 else 1 end as new from events))"


@query(f"select user_id, run, event_type, count(*) as n, string_agg(cast(event_id as varchar), ',' order by ts, event_id) as merged from {RUNS} group by user_id, run, event_type")
def merge_runs(spark, d):
    return sequence.merged_runs(events(spark, d), EVENTS, "event_type", F.col("event_id").cast("string"))


@query(f"with r as (select user_id, run, event_type, count(*) as total from {RUNS} group by user_id, run, event_type), p as (select *, unnest(generate_series(0, (total - 1) // 2)) as part from r) select user_id, run, part, event_type, cast(least(2, total - part * 2) as bigint) as n from p")
def rle_runs(spark, d):
    return sequence.split_runs(events(spark, d), EVENTS, "event_type", 2).select("user_id", "run", "part", "event_type", "n")


@query("select user_id, event_id, event_type from (select *, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as p from events) where p = 1")
def ineffective(spark, d):
    return short(sequence.effective(events(spark, d), EVENTS, F.col("event_type") == "purchase"), "event_type")


def opens():
    return F.col("event_type") == "signup"


def closes():
    return F.col("event_type") == "error"


DEPTH = "(select *, cast(sum(case event_type when 'signup' then 1 when 'error' then -1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bigint) as depth from events)"


@query(f"select user_id, min(depth) as low, arg_max(depth, event_id) as last, min(depth) >= 0 and arg_max(depth, event_id) = 0 as balanced from {DEPTH} group by user_id")
def bracket_depth(spark, d):
    return sequence.balanced(events(spark, d), EVENTS, opens(), closes())


@query(
    f"with b as (select *, event_type = 'signup' as o, case when event_type = 'signup' then depth else depth + 1 end as level from {DEPTH} where event_type in ('signup', 'error')),"
    " m as (select *, lag(event_id) over (partition by user_id, level order by ts, event_id) as e, lag(o) over (partition by user_id, level order by ts, event_id) as was from b)"
    " select user_id, event_id, case when was then e end as open_row from m where not o"
)
def matching_open(spark, d):
    return short(sequence.matching_open(events(spark, d), EVENTS, opens(), closes(), "event_id"), "open_row")


@query(
    "with w as (select *, case event_type when 'click' then 1 when 'view' then 2 when 'signup' then 3 end as weight from events),"
    " r as (select *, sum(case when weight is null then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as run from w)"
    " select user_id, event_id, cast(row_number() over (partition by user_id order by run, weight nulls first, ts, event_id) - 1 as bigint) as place from r"
)
def canonical_order(spark, d):
    weight = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "signup", 3)
    return short(sequence.canonical_order(events(spark, d), EVENTS, weight), "place")


@query(
    "with p as (select user_id, event_id, ts, event_id % 7 as x, cast(floor(value) as bigint) as y from events), n as (select *, lag(x) over w as x0, lag(y) over w as y0, lead(x) over w as x2, lead(y) over w as y2 from p window w as (partition by user_id order by ts, event_id))"
    " select user_id, event_id, coalesce((x - x0) * (y2 - y0) - (y - y0) * (x2 - x0) = 0, false) as aligned from n"
)
def collinear_points(spark, d):
    return short(sequence.collinear(events(spark, d), EVENTS, F.col("event_id") % 7, F.floor("value").cast("bigint")), "aligned")


@query(
    "with p as (select l_orderkey, l_linenumber, l_linenumber // 2 % 2 as x, (l_linenumber + 1) // 2 % 2 * 3 as y from lineitem), n as (select *, lead(x, 1) over w as x1, lead(y, 1) over w as y1, lead(x, 2) over w as x2, lead(y, 2) over w as y2, lead(x, 3) over w as x3, lead(y, 3) over w as y3 from p window w as (partition by l_orderkey order by l_linenumber))"
    " select l_orderkey, l_linenumber, cast(x2 - x as bigint) as width, cast(y2 - y as bigint) as height from n where (y = y1 and x1 = x2 and y2 = y3 and x3 = x) or (x = x1 and y1 = y2 and x2 = x3 and y3 = y)"
)
def rectangle_pattern(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    s = sequence.Sequence("l_orderkey", ("l_linenumber",))
    out = sequence.rectangles(lines, s, F.floor(F.col("l_linenumber") / 2) % 2, F.floor((F.col("l_linenumber") + 1) / 2) % 2 * 3)
    return out.select("l_orderkey", "l_linenumber", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))


# Scalars ---------------------------------------------------------------------------------------------------------


@query("select o_orderkey, floor(o_totalprice * 10.0 + 0.5) / 10.0 as up, floor(-o_totalprice / 4 * 1.0 + 0.5) / 1.0 as down from orders")
def round_half_up(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.round_half_up(F.col("o_totalprice"), 1).alias("up"), N.round_half_up(-F.col("o_totalprice") / 4, 0).alias("down"))


@query("select p_partkey, case when t = '-0' then '0' else t end as shortest from (select p_partkey, regexp_replace(regexp_replace(regexp_replace(printf('%.6f', floor(v * 1000000.0 + 0.5) / 1000000.0), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), '^(-?)0\\.', '\\1.') as t from (select p_partkey, (p_retailprice - 1000) / 1000 as v from part))")
def shortest_number(spark, d):
    return table(spark, d, "part").select("p_partkey", N.shortest_number((F.col("p_retailprice") - 1000) / 1000).alias("shortest"))


@query("select s_suppkey, 2.0 * k as a, 3.0 as b, 0.0 + k * -1.0 as c, 2.0 as d, s_acctbal * 2.0 + 5.0 * -1.0 + 1.0 as e, s_acctbal * 3.0 / k + 5.0 * 2.0 / k - 7.0 as f from (select s_suppkey, s_acctbal, cast(s_suppkey % 5 + 1 as double) as k from supplier)")
def affine_product(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 5 + 1).cast("double").alias("k"))
    zero, one = F.lit(0.0), F.lit(1.0)
    m = [F.lit(2.0), F.lit(3.0) / F.col("k"), F.lit(-1.0), F.lit(2.0) / F.col("k"), one, F.lit(-7.0)]
    n = [F.col("k"), zero, zero, F.col("k"), F.col("s_acctbal"), F.lit(5.0)]
    return s.select("s_suppkey", *[F.round(c, 6).alias(x) for c, x in zip(N.affine_product(m, n), "abcdef")])


ORACLE_SQL["affine_product"] = "select s_suppkey, round(2.0 * k, 6) as a, round(3.0 / k * k, 6) as b, round(-1.0 * k, 6) as c, round(2.0 / k * k, 6) as d, round(s_acctbal * 2.0 + 5.0 * -1.0 + 1.0, 6) as e, round(s_acctbal * (3.0 / k) + 5.0 * (2.0 / k) - 7.0, 6) as f from (select s_suppkey, s_acctbal, cast(s_suppkey % 5 + 1 as double) as k from supplier)"


@query("select p_partkey, cast(greatest(0, ceil(log10(p_retailprice / 3000)) + 2) as bigint) as digits, cast(greatest(0, 5 - floor(log10(abs(p_retailprice / 3000)))) as bigint) as matrix_digits from part")
def useful_precision(spark, d):
    scale = F.col("p_retailprice") / 3000
    return table(spark, d, "part").select("p_partkey", N.useful_precision(scale).alias("digits"), N.matrix_precision(scale).alias("matrix_digits"))


@query("select doc_id, cast(i as bigint) as part, substr(text, cast(i as int) * 100 + 1, 100) as chunk from (select doc_id, text, unnest(generate_series(0, (greatest(length(text), 1) - 1) // 100)) as i from documents)")
def chunks(spark, d):
    return stats.chunks(table(spark, d, "documents"), "doc_id", "text", 100)


@query("select doc_id, bits, components, n_chars * 8 // (bits * components) as width from documents, (select unnest([2, 4, 8, 16]) as bits), (select unnest([1, 2, 3, 4]) as components) where n_chars > 0 and n_chars * 8 % (bits * components) = 0")
def bitmap_configs(spark, d):
    return choice.bitmap_configurations(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars")




@query("with c as (select doc_id, length(text) as cost, 0 as ord, 'none' as name from documents union all select doc_id, length(replace(text, ' ', '')) + 11, 1, 'spaceless' from documents union all select doc_id, length(replace(text, 'th', '')) + 40, 2, 'shortened' from documents) select doc_id, cast(cost as bigint) as cost, name from (select *, row_number() over (partition by doc_id order by cost, ord) as r from c) where r = 1")
def best_candidate(spark, d):
    t = F.col("text")
    costs = {"none": F.length(t), "spaceless": F.length(F.replace(t, F.lit(" "), F.lit(""))) + 11, "shortened": F.length(F.replace(t, F.lit("th"), F.lit(""))) + 40}
    return choice.cheapest(table(spark, d, "documents"), ["doc_id"], costs)


@query("select p_partkey, lower(hex(p_name)) || '>' as encoded, p_name as decoded from part")
def hex_roundtrip(spark, d):
    encoded = F.concat(F.lower(F.hex("p_name")), F.lit(">"))
    return table(spark, d, "part").select("p_partkey", encoded.alias("encoded"), stats.lenient_unhex(encoded).cast("string").alias("decoded"))


@query("select distinct tag from (select unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)")
def xml_prefixes(spark, d):
    return xmltext.names(table(spark, d, "pages"), "html", "<([a-zA-Z][a-zA-Z0-9]*)", "tag")


@query("select page_id, regexp_replace(html, '>\\s+<', '><', 'g') as html from pages")
def xml_strip_indent(spark, d):
    return table(spark, d, "pages").select("page_id", xmltext.strip_indent(F.col("html")).alias("html"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# Predictors over rows --------------------------------------------------------------------------------------------

BYTES = "(select user_id, ts, event_id, cast(floor(value * 10) as bigint) % 256 as b from events)"


def event_bytes(spark, d) -> DataFrame:
    return events(spark, d).select("user_id", "ts", "event_id", (F.floor(F.col("value") * 10).cast("bigint") % 256).alias("b"))


@query(f"select user_id, event_id, b, ((b - coalesce(lag(b) over {W}, 0)) % 256 + 256) % 256 as delta from {BYTES}")
def delta_sub(spark, d):
    return choice.delta(event_bytes(spark, d), EVENTS, "b", "delta").select("user_id", "event_id", "b", "delta")


@query(f"select user_id, event_id, b as value from {BYTES}")
def undelta(spark, d):
    deltas = choice.delta(event_bytes(spark, d), EVENTS, "b", "delta").drop("b")
    return choice.undelta(deltas, EVENTS, "delta", "value").select("user_id", "event_id", "value")


PIXELS = "(select vec_id as r, i as c, ((cast(floor(e * 1000) as bigint)) % 256 + 256) % 256 as v from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as i from embeddings))"


def pixels(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "e"))
    return e.select("r", F.col("c").cast("bigint").alias("c"), F.pmod(F.floor(F.col("e").cast("double") * 1000).cast("bigint"), F.lit(256)).alias("v"))


PIXELS = PIXELS.replace("e * 1000", "cast(e as double) * 1000")


@query(f"select r, c, v, ((v - coalesce(lag(v) over (partition by c order by r), 0)) % 256 + 256) % 256 as up from {PIXELS}")
def delta_up(spark, d):
    return choice.predicted(pixels(spark, d), "r", "c", "v", "up").select("r", "c", "v", "up")


@query(
    f"with p as (select r, c, v, coalesce(lag(v) over (partition by r order by c), 0) as a, coalesce(lag(v) over (partition by c order by r), 0) as b from {PIXELS}), q as (select *, coalesce(lag(b) over (partition by r order by c), 0) as k from p),"
    " s as (select *, abs(b - k) as pa, abs(a - k) as pb, abs(a + b - 2 * k) as pc from q)"
    " select r, c, ((v - case when pa <= pb and pa <= pc then a when pb <= pc then b else k end) % 256 + 256) % 256 as paeth, ((v - (a + b) // 2) % 256 + 256) % 256 as average from s"
)
def paeth(spark, d):
    return choice.predicted(pixels(spark, d), "r", "c", "v", "paeth").select("r", "c", "paeth", "average")


@query(f"select r, c % 3 as channel, c // 3 as place, v from {PIXELS}")
def channel_split(spark, d):
    return choice.channels(pixels(spark, d), "c", 3).select("r", "channel", "place", "v")


# Sets ------------------------------------------------------------------------------------------------------------


@query("select c_custkey as key from customer except select o_custkey from orders")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("select s_nationkey as key from supplier union select c_nationkey from customer")
def set_union(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("select s_nationkey as key from supplier intersect select c_nationkey from customer where c_acctbal < 0")
def set_intersection(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).intersect(table(spark, d, "customer").where("c_acctbal < 0").select("c_nationkey"))


# Codecs, documents, streams --------------------------------------------------------------------------------------


def round_trip(spark, d, codec: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", (codecs.decode(codecs.encode(raw, codec), codec) == raw).alias("same"))


for _codec, _name in (("deflate", "zlib"), ("a85", "ascii85"), ("lzw", "lzw"), ("rle", "run_length"), ("hex", "ascii_hex")):

    def _trip(spark, d, codec=_codec):
        return round_trip(spark, d, codec)

    QUERIES[f"{_name}_roundtrip"] = _trip
    ORACLE_SQL[f"{_name}_roundtrip"] = "select doc_id, true as same from documents"


def bitmaps(spark, d) -> DataFrame:
    """Embeddings as one-row-a-quarter bitmaps of bytes."""
    values = F.transform("embedding", lambda e: F.chr(F.lit(65) + F.pmod(F.floor(e.cast("double") * 100).cast("bigint"), F.lit(26))))
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.array_join(values, "").cast("binary").alias("data"))


@query("select vec_id, true as optimum, true as tiff from embeddings")
def png_predict_roundtrip(spark, d):
    df = bitmaps(spark, d)
    # Rows of eight columns, or of one where eight do not divide the length; a function gets all rows, so those of the other width are null.
    of = lambda kind, columns, x: predictors.unpredict_column(predictors.predict_column(x, kind, columns, 1), kind, columns, 1) == x
    even = F.col("n") % 8 == 0
    trip = lambda kind: F.coalesce(of(kind, 8, F.when(even, F.col("data"))), of(kind, 1, F.when(~even, F.col("data"))))
    return df.select("vec_id", trip("optimum").alias("optimum"), trip("tiff").alias("tiff"))


def document_files(spark, d, plain: bool = False) -> DataFrame:
    """Each document as a PDF file of six objects, one of them unused, its text in a compressed stream and, again, in the same or in a plain one."""
    body = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).cast("binary")
    raw = F.col("text").cast("binary")
    docs = table(spark, d, "documents").select(F.format_string("doc-%d", "doc_id").alias("path"), raw.alias("raw"), codecs.encode(raw, "deflate").alias("small"))
    row = lambda num, b, s: F.struct(F.lit(num).cast("bigint").alias("num"), F.lit(0).cast("bigint").alias("gen"), b.alias("body"), s.cast("binary").alias("stream"))
    none = F.lit(None).cast("binary")
    packed = body("<</Filter/FlateDecode/Length ", F.octet_length("small").cast("string"), ">>")
    again = row(5, body("<</Length ", F.octet_length("raw").cast("string"), ">>"), F.col("raw")) if plain else row(5, packed, F.col("small"))
    rows = F.array(
        row(1, body("<</Type/Catalog/Pages 2 0 R>>"), none),
        row(2, body("<</Type/Pages/Count 1/Kids[3 0 R]>>"), none),
        row(3, body("<</Type/Page/Parent 2 0 R/Contents[4 0 R 5 0 R]>>"), none),
        row(4, packed, F.col("small")),
        again,
        row(7, body("<</Unused true>>"), none),
    )
    return pdf.assembled(docs.select("path", rows.alias("objects"), body("<</Root 1 0 R>>").alias("trailer")))


@query("select 'doc-' || doc_id as path, sha256(text) as hash from documents")
def pdf_extract(spark, d):
    found = pdf.extract(pdf.objects(document_files(spark, d)), 4)
    return found.select("path", F.sha2("data", 256).alias("hash"))


@query("select 'doc-' || doc_id as path, cast(2 as bigint) as streams, cast(6 as bigint) as objects, cast(1 as bigint) as duplicates from documents")
def pdf_stat(spark, d):
    objects = refs.written(pdf.objects(document_files(spark, d)).select("path", "pos", "num", "stream"))  # files are parsed once
    marked = pdf.hashes(objects).groupBy("path").agg(F.count(F.lit(1)).alias("streams"), F.count_if("is_duplicate").alias("duplicates"))
    return objects.where("num is not null").groupBy("path").agg(F.count(F.lit(1)).alias("objects")).join(marked, "path").select("path", "streams", "objects", "duplicates")


@query("select 'doc-' || doc_id as path, cast(num as bigint) as num from documents, (select unnest([1, 2, 3, 4]) as num)")
def pdf_optimize(spark, d):
    """Objects that stay: the second stream is a duplicate, the last object unused."""
    return pdf.optimize(pdf.objects(document_files(spark, d))).select("path", "num")


@query("select 'doc-' || doc_id as path, cast(6 as bigint) as objects, cast(6 + 2 as bigint) as streamed, sha256(text) as hash from documents")
def pdf_compact(spark, d):
    """Files with object streams and a cross-reference stream, read back: all plain objects are inside, and the text is what it was in the compressed stream and in the plain one."""
    own = pdf.objects(document_files(spark, d, plain=True))
    back = pdf.with_data(pdf.objects(pdf.assemble(own, compact=True)).where("num is not null"))  # files are parsed once, and their texts not dealt out again
    each = back.select("path", "kind", "num", "pos", F.sha2("data", 256).alias("hash"))
    last = lambda n: F.max_by("hash", F.when(F.col("num") == n, F.col("pos"))).alias(f"hash_{n}")
    inside = each.groupBy("path").agg(F.count_if(F.col("kind").isin("object", "stream")).alias("objects"), F.count(F.lit(1)).alias("streamed"), last(4), last(5))
    return inside.select("path", "objects", "streamed", F.when(F.col("hash_4") == F.col("hash_5"), F.col("hash_4")).alias("hash"))


@query("select 'doc-' || doc_id as path, cast(8 as bigint) as num, sha256(' ' || text || ' ' || text) as hash from documents")
def pdf_merge_contents(spark, d):
    """The two content streams of each page as one new object."""
    found = pdf.merged_contents(pdf.objects(document_files(spark, d)))
    return found.where("num = 8").select("path", "num", F.sha2("stream", 256).alias("hash"))


@query("""
    select 'doc-' || doc_id as path, cast(num as bigint) as num, case when num in (4, 5) then 'vector' else 'object' end as category,
        case when num in (4, 5) then cast(octet_length(encode(text)) as bigint) end as uncompressed,
        case num when 1 then 'Catalog' when 2 then 'Pages' when 3 then 'Page' else '' end as description
    from documents, (select unnest([1, 2, 3, 4, 5, 7]) as num)
""")
def pdf_info(spark, d):
    return pdf.info(pdf.objects(document_files(spark, d))).select("path", "num", "category", F.col("uncompressed").cast("bigint").alias("uncompressed"), "description")


@query("""
    select 'doc-' || doc_id as path, cast(2 as bigint) as vector_count, cast(0 as bigint) as font_count, true as sizes_add_up from documents
""")
def pdf_stat_sizes(spark, d):
    files = document_files(spark, d).select("path", "content", F.octet_length("content").alias("length"))
    got = pdf.stat(pdf.objects(files), files.select("path", "length"))
    known = sum((F.col(f"{c}_size") for c in pdf.CATEGORIES), F.lit(0))
    return got.select("path", F.col("vector_count").cast("bigint").alias("vector_count"), F.col("font_count").cast("bigint").alias("font_count"), ((known + F.col("structures") == F.col("length")) & (F.col("structures") > 0)).alias("sizes_add_up"))


def record_files(spark, d) -> DataFrame:
    """Each customer as a file of three objects that name each other in a circle."""
    body = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary")
    rows = table(spark, d, "customer").select(F.format_string("c-%d", "c_custkey").alias("path"), F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("n"))
    rows = rows.repartition("path")  # a megabyte of these keys is many files
    row = lambda num, b: F.struct(F.lit(num).cast("bigint").alias("num"), F.lit(0).cast("bigint").alias("gen"), b.alias("body"), F.lit(None).cast("binary").alias("stream"))
    objects = F.array(row(1, body("<</Type/Catalog/Items 2 0 R>>")), row(2, body("[3 0 R 3 0 R]")), row(3, body("<</Id ", F.col("k"), "/Nation ", F.col("n"), "/Up 1 0 R>>")))
    return pdf.assembled(rows.select("path", objects.alias("objects"), body("<</Root 1 0 R>>").alias("trailer")))


_ITEM = "'<<' || chr(10) || '      /Id ' || c_custkey || chr(10) || '      /Nation ' || c_nationkey || chr(10) || '      /Up 1 0 R' || chr(10) || '    >>'"


@query(f"select 'c-' || c_custkey as path, '<<' || chr(10) || '  /Items [' || {_ITEM} || ' ' || {_ITEM} || ']' || chr(10) || '  /Type /Catalog' || chr(10) || '>>' as text from customer")
def pdf_get(spark, d):
    return pdf.get(pdf.objects(record_files(spark, d)), 1)


def drawings(spark, d) -> DataFrame:
    """A content stream for each supplier, with what rewriting takes out."""
    k = (F.col("s_suppkey") + 1).cast("string")
    text = F.concat(F.lit("q 1 0 0 1 0 0 cm "), k, F.lit("5 w "), k, F.lit("5 w 0 0 m 10 "), k, F.lit(" l S Q BT ET .5 .5 .5 rg "), k, F.lit(" 0 m 9 9 l S"))
    return table(spark, d, "supplier").select(F.lit("s").alias("path"), F.col("s_suppkey").cast("bigint").alias("num"), text.cast("binary").alias("data"))


@query("select cast(s_suppkey as bigint) as num, 'q ' || (s_suppkey + 1) || '5 w 0 0 m 10 ' || (s_suppkey + 1) || ' l S Q .5 g ' || (s_suppkey + 1) || ' 0 m 9 9 l S' as program from supplier")
def content_optimize(spark, d):
    """Drawings after the rules: the identity matrix, the width that is set already and the empty text go, equal components are gray."""
    return drawings(spark, d).select("num", content.rewritten_column(F.col("data")).cast("string").alias("program"))


@query("""
    select 's' as path, cast(s_suppkey as bigint) as num, cast(x.i as bigint) as seq, x.op as op, x.n as n from supplier, (
        select unnest([{'i': 0, 'op': 'q', 'n': 0}, {'i': 1, 'op': 'cm', 'n': 6}, {'i': 2, 'op': 'w', 'n': 1}, {'i': 3, 'op': 'w', 'n': 1}, {'i': 4, 'op': 'm', 'n': 2},
            {'i': 5, 'op': 'l', 'n': 2}, {'i': 6, 'op': 'S', 'n': 0}, {'i': 7, 'op': 'Q', 'n': 0}, {'i': 8, 'op': 'BT', 'n': 0}, {'i': 9, 'op': 'ET', 'n': 0},
            {'i': 10, 'op': 'rg', 'n': 3}, {'i': 11, 'op': 'm', 'n': 2}, {'i': 12, 'op': 'l', 'n': 2}, {'i': 13, 'op': 'S', 'n': 0}]) as x)
""")
def content_commands(spark, d):
    return content.commands(drawings(spark, d)).select("path", "num", "seq", "op", F.size("params").alias("n"))


@query("select cast(s_suppkey as bigint) as num, 'q' || chr(10) || '  1 0 0 1 0 0 cm' || chr(10) || '  ' || (s_suppkey + 1) || '5 w' || chr(10) || '  ' || (s_suppkey + 1) || '5 w' || chr(10) || '  0 0 m' || chr(10) || '  10 ' || (s_suppkey + 1) || ' l' || chr(10) || '  S' || chr(10) || 'Q' || chr(10) || 'BT' || chr(10) || 'ET' || chr(10) || '.5 .5 .5 rg' || chr(10) || (s_suppkey + 1) || ' 0 m' || chr(10) || '9 9 l' || chr(10) || 'S' as lines from supplier")
def content_human(spark, d):
    return drawings(spark, d).select("num", content.human_column(F.col("data")).alias("lines"))


@query("select cast(c_custkey as bigint) as num, 'glyf' as tag, cast(octet_length(encode(c_name)) as bigint) as length, cast(28 as bigint) as start, true as sound from customer")
def font_table_list(spark, d):
    """Fonts of two tables, rebuilt without the one that may go."""
    data = fonts.built_column(F.lit("glyf"), F.col("c_name").cast("binary"), F.lit("DSIG"), F.col("c_mktsegment").cast("binary"))
    own = table(spark, d, "customer").select(F.lit("c").alias("path"), F.col("c_custkey").cast("bigint").alias("num"), data.alias("data"))
    got = fonts.font_tables(own).where("tag = 'glyf'")
    return got.select("num", "tag", "length", F.col("offset").alias("start"), (F.col("checksum") == F.col("computed")).alias("sound"))


def glyphs(spark, d) -> DataFrame:
    """A glyph of three points and three bytes of hints for each customer; the flag of the points is written once, with repeats."""
    two = lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")
    k = F.col("c_custkey")
    digits = F.concat(F.lit("0001" + "0000" * 4 + "0002" + "0003" + "b0b1b2" + "0902"), two(k % 1000), F.lit("0001ffff0005"), two(k % 7), F.lit("0000"))
    return table(spark, d, "customer").select(F.lit("c").alias("path"), k.cast("bigint").alias("num"), F.unhex(digits).alias("data"))


@query("""
    select cast(c_custkey as bigint) as num, cast(i as bigint) as seq, cast(c_custkey % 1000 + case i when 1 then 1 else 0 end as bigint) as x,
        cast(5 + case i when 0 then 0 else c_custkey % 7 end as bigint) as y, true as on_curve
    from customer, (select unnest([0, 1, 2]) as i)
""")
def glyph_points(spark, d):
    return fonts.glyph_points(glyphs(spark, d)).select("num", "seq", "x", "y", "on_curve")


@query("""
    select cast(c_custkey as bigint) as num, '0001' || repeat('0000', 4) || '0002' || '0000' || '0902' || lpad(lower(hex(c_custkey % 1000)), 4, '0') || '0001ffff0005' || lpad(lower(hex(c_custkey % 7)), 4, '0') || '0000' as glyph
    from customer
""")
def glyph_without_hints(spark, d):
    return glyphs(spark, d).select("num", F.lower(F.hex(fonts.without_hints_column(F.col("data")))).alias("glyph"))


@query("select doc_id, lower(hex(encode(text))) || '>' as coded from documents")
def ascii_hex_encoded(spark, d):
    return table(spark, d, "documents").select("doc_id", codecs.encode(F.col("text").cast("binary"), "hex").cast("string").alias("coded"))


#: Known pairs of data and code in hex, fixed values of the formats.
VECTORS = {
    "a85": [("4d616e20", "396a716f5e7e3e"), ("00000000", "7a7e3e"), ("4d", "39607e3e")],
    "rle": [("6161616161", "fc61"), ("616263", "02616263")],
    "lzw": [("2d2d2d2d2d412d2d2d42", "800b6050220c0c8501")],
    "hex": [("00ff", "303066663e")],
}


@query(" union all ".join(f"select '{c}' as codec, '{a}' as data, '{b}' as coded, '{a}' as back" for c, pairs in VECTORS.items() for a, b in pairs))
def codec_vectors(spark, d):
    """What the codecs make of known data, and of known code."""
    ship(spark)
    out = None
    for codec, pairs in VECTORS.items():
        df = spark.createDataFrame([(codec, a, b) for a, b in pairs], "codec string, data string, code string")
        df = df.select("codec", "data", F.lower(F.hex(codecs.encode(F.unhex("data"), codec))).alias("coded"), F.lower(F.hex(codecs.decode(F.unhex("code"), codec))).alias("back"))
        out = df if out is None else out.unionByName(df)
    return out


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_event_counts(spark, d):
    return events_stream.windowed_counts(table(spark, d, "events")).select("start", "event_type", "n")


@query(ORACLE_SQL["state_changes"])
def stream_state_changes(spark, d):
    """The same as state_changes, as a stream over the files of events in micro-batches."""
    schema = table(spark, d, "events").schema
    where = f"{d}/events.parquet"
    files = spark.readStream.schema(schema)
    source = files.option("pathGlobFilter", "events.parquet").parquet(d) if d and not _is_folder(spark, where) else files.parquet(where)
    return streamed(spark, events_stream.state_changes(source), "append")


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def streamed(spark, df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is now, and reads its output."""
    path = f"{refs.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    job = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
