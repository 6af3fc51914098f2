import pytest
from pyspark.sql import functions as F

from docgrain.functions import maps
from docgrain.functions import numbers as N
from docgrain.operators import ordered, refs, sequence, stats, xmltext
from docgrain.sources import tables
from docgrain.streaming import events as E


def test_numbers(spark):
    df = spark.createDataFrame([(-2.5, 0), (2.5, 255), (0.123456789, 256), (-0.0000001, 2**40)], "x double, n long")
    got = df.select(N.round_half_up(F.col("x"), 0).alias("r"), N.shortest_number(F.col("x")).alias("s"), N.byte_width(F.col("n")).alias("w"), N.digits_of(F.col("n"), N.BASE26, "ns").alias("b")).collect()
    assert [r["r"] for r in got] == [-2.0, 3.0, 0.0, 0.0]
    assert [r["s"] for r in got] == ["-2.5", "2.5", ".123457", "0"]
    assert [r["w"] for r in got] == [1, 1, 2, 6] and [r["b"] for r in got][:3] == ["nsa", "nsjv", "nsjw"]


def test_maps(spark):
    d = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    one = spark.range(1).select(
        maps.get(d, "a").alias("a"), maps.get(d, "x", F.lit("?")).alias("x"), maps.put(d, "a", F.lit("9")).alias("p"), maps.update(d, "b", F.lit(None).cast("string")).alias("u"),
        maps.put_if(d, "b", F.lit(None).cast("string")).alias("k"), maps.merge(d, F.create_map(F.lit("b"), F.lit("7"), F.lit("c"), F.lit("3"))).alias("m"),
        maps.without_defaults(d, {"a": "1", "b": "1"}).alias("w"), maps.set_stream(d, F.lit("xyz").cast("binary"), True).alias("s"),
    ).first()
    assert one["a"] == "1" and one["x"] == "?" and one["p"] == {"a": "9", "b": "2"} and one["u"] == {"a": "1"} and one["k"] == {"a": "1", "b": "2"}
    assert one["m"] == {"a": "1", "b": "2", "c": "3"} and one["w"] == {"b": "2"} and one["s"]["Length"] == one["s"]["Length1"] == "3"


def test_prefix_sums_and_ranks_over_buckets(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7).alias("k"), (F.col("id") % 5 + 1).alias("v"))
    got = ordered.prefix_sum(df, "k", "v", "start", width=100).orderBy("k").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["v"]
    names = df.select(F.col("k").cast("string").alias("name"))
    ranked = ordered.rank_by(names, {"n": F.length("name"), "h": F.substring("name", 1, 1)}, [F.col("name")], "place").collect()
    assert [r["name"] for r in sorted(ranked, key=lambda r: r["place"])] == sorted((str(7 * i) for i in range(1000)), key=lambda x: (len(x), x))
    assert ordered.fill_gaps(spark.createDataFrame([(3,), (7,)], "key long"), "key").orderBy("key").collect()[1]["is_free"] is True
    assert ordered.fill_gaps(spark.createDataFrame([], "key long"), "key").count() == 0


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", "y")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["depth"] for r in refs.closure(e).collect()}
    assert got[("a", "b")] == 1 and got[("a", "a")] == 3 and len(got) == 10


def test_last_versions_and_ladder(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 5, "z")], "k long, o long, v string")
    assert {r["k"]: r["v"] for r in refs.last_versions(df, ["k"], [F.col("o")], ["v"]).collect()} == {1: None, 2: "z"}
    assert [r[0] for r in df.orderBy("o").select(stats.ladder([(F.col("v") == "a", "first"), (F.col("o") < 3, "second")], "rest")).collect()] == ["first", "second", "rest"]


def test_sequences_on_small_programs(spark):
    s = sequence.Sequence("p", ("i",))
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("((a)b))")] + [(2, i, c) for i, c in enumerate("()()")], "p long, i long, c string")
    opens, closes = F.col("c") == "(", F.col("c") == ")"
    assert {r["p"]: r["balanced"] for r in sequence.balanced(df, s, opens, closes).collect()} == {1: False, 2: True}
    got = {(r["p"], r["i"]): r["open_row"] for r in sequence.matching_open(df, s, opens, closes, "i").collect()}
    assert got == {(1, 3): 1, (1, 5): 0, (1, 6): None, (2, 1): 0, (2, 3): 2}
    runs = spark.createDataFrame([(1, i, c) for i, c in enumerate("aaab")], "p long, i long, c string")
    assert sorted((r["run"], r["part"], r["n"]) for r in sequence.split_runs(runs, s, "c", 2).collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]


def test_markup(spark):
    df = spark.createDataFrame([("<svg:g xmlns:svg='u' svg:x='1'>\n  <svg:p/> t </svg:g>",)], "t string")
    got = df.select(xmltext.rename_prefixes(xmltext.strip_indent(F.col("t")), {"svg": "a"})).first()[0]
    assert got == "<a:g xmlns:a='u' a:x='1'><a:p/> t </a:g>"


@pytest.mark.parametrize("kind", ["parquet", "csv", "tsv", "json"])
def test_tables_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a "quoted", text\nof lines'), (2, None)], "k long, v string")
    path = str(tmp_path / "t")
    tables.write_table(df, path, kind)
    assert sorted(map(tuple, tables.read_table(spark, path, kind, "k long, v string").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_table(df, path, kind)
    with pytest.raises(ValueError):
        tables.read_table(spark, path, "nothing")


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(u, i, t) for i, (u, t) in enumerate([(1, "a"), (1, "a"), (2, "b"), (1, "c"), (2, "b"), (1, "c"), (2, "a"), (1, "a")])]
    schema = "user_id long, event_id long, event_type string"
    for k in range(4):  # a file a micro-batch, in order
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    E.state_changes(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    batch = sequence.state_changes(spark.createDataFrame(rows, schema), sequence.Sequence("user_id", ("event_id",)), "event_type")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.select("user_id", "event_id", "event_type").collect()))


def test_windows_and_watermarks(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df in (("w", E.windowed_counts(source)), ("d", E.distinct_within(source.select("ts", "user_id", "event_type"), ["user_id", "event_type"], late="1000 days"))):
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{name}")).trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
    every = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert 0 < spark.read.parquet(str(tmp_path / "w")).agg(F.sum("n")).first()[0] <= every.count()
    assert spark.read.parquet(str(tmp_path / "d")).count() == every.select("user_id", "event_type").distinct().count()


def test_prefix_sum_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 5), (1, 2), (70_000, 3)], "k long, v long")
    assert sorted((r["k"] or 0, r["start"]) for r in ordered.prefix_sum(df, "k", "v", "start").collect()) == [(0, 0), (1, 5), (70_000, 7)]


def test_loops_go_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(67)], "src long, dst long").coalesce(1)
    assert refs.closure(chain).agg(F.max("depth")).first()[0] == 67
    assert refs.closure(chain, rounds=2).agg(F.max("depth")).first()[0] == 3


def test_small_numbers_and_dumps(spark):
    df = spark.createDataFrame([(b"abc", b"xyz", 3.0, 4.0)], "a binary, b binary, x double, y double")
    m = [F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(9.0), F.lit(9.0)]
    sx, sy = N.matrix_scale(m, F.col("x"), F.col("y"))
    got = df.select(N.interleaved([F.col("a"), F.col("b")]).alias("w"), N.hex_dump(F.col("a"), 1).alias("h"), sx.alias("sx"), sy.alias("sy"), N.useful_text_precision(F.lit(10.0)).alias("t"), N.useful_color_precision().alias("c")).first()
    assert (bytes(got["w"]), got["h"], got["sx"], got["sy"], got["t"], got["c"]) == (b"axbycz", "62 63", 6.0, 15.0, 4, 2)
