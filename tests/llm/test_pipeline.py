import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from docgrain.llm import queries, toxicity


def test_stages_against_plain_versions(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "line_dedup", "simhash", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == columns
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert set(seen["toxicity"]) == {k for k in before if scores[k] < 0.5}
    assert all(seen["toxicity"][k] == before[k] for k in seen["toxicity"])
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()} & set(seen["toxicity"])
    assert len(good & set(seen["quality"])) > 0.9 * len(good)
    assert set(seen["line_dedup"]) == set(seen["quality"])
    for k, r in seen["line_dedup"].items():
        assert set(r["text"].split("\n")) <= set(before[k]["text"].split("\n"))
    texts = {}
    for k, r in sorted(seen["line_dedup"].items()):
        texts.setdefault(r["text"], k)
    assert set(seen["simhash"]) <= set(texts.values())  # of equal texts only the first
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(seen["simhash"])


def test_run_gives_the_pieces(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[0] == "doc_id" and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert zlib.crc32(b"x")


def test_stages_take_nulls_empty_texts_and_no_rows(spark, sf_dir, edge_docs, no_docs):
    """Each stage but the last keeps the columns and brings no row that it was not given; extra columns stay as they are."""
    extra = edge_docs.withColumn("score", F.lit("x")).withColumn("line", F.lit("y"))
    for docs in (extra, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = now.count()
            now = stage(spark, now, sf_dir).cache()
            assert now.columns == docs.columns and now.count() <= rows, name
        if docs is extra:
            assert now.where("score != 'x' or line != 'y'").count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
        assert packed.columns[0] == "doc_id" and (docs is extra or packed.count() == 0)
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
