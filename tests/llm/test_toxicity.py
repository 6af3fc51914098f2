import random
import zlib

from pyspark.sql import functions as F

from docgrain.llm import toxicity as T

from .conftest import prose

BAD = ["gronkish", "gronkard", "blightful", "blighter", "vexator"]


def corpus(n=1200):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, r.randint(30, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words[r.randrange(len(words))] = r.choice(BAD)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(d, y).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[i]["predicted"] == labels[i][1] for i in held) / len(held)
    assert right > 0.95
    model = T.train(d, y)
    words = prose(77, 40).split()
    words[3] = words[20] = words[30] = "gronkisch"  # never seen
    assert model.words(words).mean() > model.words(prose(77, 40).split()).mean() + 1


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (T.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (labels, turned))
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_grams_are_those_of_each_word():
    words = ["a", "abc", "wörter", "x" * 30, "😀"]
    buckets, owners, sizes = T.grams_of(words)
    for i, w in enumerate(words):
        alone, _, n = T.grams_of([w])
        assert sorted(buckets[owners == i]) == sorted(alone) and sizes[i] == n[0] == 1 + sum(max(0, len(w) + 3 - k) for k in range(3, 7))


def test_edges(spark, clashing, no_docs):
    y = spark.createDataFrame([(3, 1), (5, 0), (7, None), (None, 1), (3, 1), (99, 0)], "doc_id long, toxic int")
    for labels in (y, y.where("1 = 0")):
        got = T.toxicity(clashing, labels).collect()
        assert len(got) == clashing.count() and all(0 <= r["score"] <= 1 for r in got)
        assert T.accept(clashing, labels).columns == clashing.columns
    assert T.toxicity(no_docs, y).count() == 0


def test_scores_are_those_of_a_plain_reading(spark, edge_docs):
    """Every score is the softmax of the mean over words of the mean over each word's n-grams, read one by one."""
    import math

    docs, labels = corpus(400)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(d, y)

    def plain(text):
        words = (text or "").lower().split()
        logits = []
        for w in words:
            buckets = T.grams_of([w])[0]
            logits.append(sum(float(model.logits[b]) for b in buckets) / len(buckets))
        return 1 / (1 + math.exp(-(model.bias + (sum(logits) / len(logits) if logits else 0))))

    few = d.where("doc_id < 60").union(edge_docs.where("length(text) < 1000 or text is null").select("doc_id", "text"))
    for r in T.scored(few, model, ["doc_id", "text"]).collect():
        assert abs(r["dg_score"] - plain(r["text"])) < 1e-6


def test_the_sample_holds_no_more_than_its_bound(spark):
    docs, labels = corpus(400)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, bounded = T.train(d, y, 10_000), T.train(d, y, 40)
    assert abs(whole.logits).sum() != abs(bounded.logits).sum()
    # Rows beyond the bound do not matter, nor does the order of rows.
    again = T.train(d.orderBy(F.desc("doc_id")), y.orderBy(F.desc("doc_id")), 40)
    assert (again.logits == bounded.logits).all() and again.bias == bounded.bias
