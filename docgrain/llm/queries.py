"""The queries of this subpackage's operators on the shared tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_lexicon, ctw, fingerprint, html_extract, line_dedup, packing, quality_rules, simhash, toxicity, warc
from .common import table


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the folder in DOCGRAIN_TOKENIZERS, or of the installed collection."""
    folder = os.environ.get("DOCGRAIN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs, counts=True)
    return out.select("doc_id", "source", F.col("dg_lines").alias("n_lines"), F.col("dg_dropped").alias("n_dropped"), "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *quality_rules.FEATURES, "base_failed", "kept", "quality")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("dg_fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def op10_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.encoded(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_fingerprint, op3_line_dedup, op4_quality_rules, op5_simhash, op6_toxicity, op7_warc, op8_packing, op9_ctw, op10_bpe_lexicon)}

BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = {
    "op3_line_dedup": f"""
        with lines as (
            select doc_id, source, text, i, l, trim(l, {BLANK}) as t
            from (select doc_id, source, text, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
        ), counts as (
            select source, t, count(distinct doc_id) as n from lines where t <> '' group by source, t
        ), totals as (
            select source, count(*) as total from documents group by source
        ), drops as (
            select c.source, c.t from counts c join totals using (source) where n >= {line_dedup.MIN_PAGES} and n > {line_dedup.RATIO} * total
        ), marked as (
            select lines.*, drops.t is not null as dropped from lines left join drops on lines.source = drops.source and lines.t = drops.t
        ), joined as (
            select doc_id, source, text, count(*) as n_lines, sum(case when dropped then 1 else 0 end) as n, sum(case when not dropped and t <> '' then 1 else 0 end) as filled,
                coalesce(string_agg(case when dropped then null else l end, chr(10) order by i), '') as kept
            from marked group by doc_id, source, text
        )
        select doc_id, source, cast(n_lines as bigint) as n_lines, cast(case when filled > 0 then n else 0 end as bigint) as n_dropped, case when filled > 0 and n > 0 then kept else text end as text
        from joined
    """,
}
