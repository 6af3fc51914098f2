import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.llm import fingerprint as P

from .conftest import edge_texts, prose

HASHER = P.Hasher()


def vectors(text):
    e, w = HASHER([text.encode()])
    return e[0], w[0]


def equal(a, b):
    return (a[0] == b[0]).all() and (a[1] == b[1]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=12), max_size=6), st.randoms())
def test_order_of_paragraphs_does_not_matter_and_updates_are_exact(parts, random):
    whole = vectors("\n".join(parts))
    mixed = parts[:]
    random.shuffle(mixed)
    assert equal(whole, vectors("\n".join(mixed)))
    total = vectors("")
    for p in parts:
        total = P.insert(total, vectors(p))
    assert equal(whole, total)
    if parts:
        assert equal(P.delete(whole, vectors(parts[0])), vectors("\n".join(parts[1:])))


def test_plain_version_of_the_counters():
    """Each line's runs of three words, or a shorter line as a whole, add one signed unit."""
    text = "a b c d\n\nx y\nz"
    _, wide = vectors(text)
    assert np.abs(wide).sum() <= 4 and wide.sum() % 2 == 4 % 2
    assert equal(vectors(text), vectors("z\nx y\na b c d"))
    assert not equal(vectors("a b c d"), vectors("a b d c"))


def test_likeness():
    a, b = prose(1, 400), prose(2, 400)
    c = P.edited(a, b)
    e, w = HASHER([x.encode() for x in (a, c, b, a)])
    near = P.likeness(e[[0, 0, 0]], w[[0, 0, 0]], e[[1, 2, 3]], w[[1, 2, 3]])
    assert 0.6 < near[0] < 0.9 and near[1] < 0.3 and near[2] == 1


def test_text_form_round_trip():
    e, w = HASHER([prose(5, 200).encode()])
    back = P.vectors_of(P.text_of(e, w)[0])
    assert equal((e[0], w[0]), back)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_against_brute_force(spark, clashing):
    for parts in (1, 3, 7):
        got = P.edited_fingerprints(clashing, parts).collect()
        rows = [(r["doc_id"], r["text"]) for r in clashing.select("doc_id", "text").collect()]
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    own = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] is not None}
    assert own[0] == own[1] == own[2] and own[3] == own[4] and own[5] == own[6] and len({own[i] for i in (3, 5, 7, 8)}) == 4


def test_empty_one_row_and_large_ids(spark, no_docs):
    assert P.edited_fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(2**62 + 1, "abcdefgh")], "doc_id long, text string")
    assert P.edited_fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    many = spark.createDataFrame([(2**62 + i, "t%d " % i * 9) for i in range(50)], "doc_id long, text string")
    got = P.edited_fingerprints(many, 6).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(brute([(r["doc_id"], r["text"]) for r in many.collect()]))
    assert len(edge_texts()) == 13


def test_long_texts_in_blocks_are_as_whole(monkeypatch):
    texts = [prose(1, 900), "one line " + " ".join(f"w{i}" for i in range(400)) + "\nshort\n\n" + "x" * 700 + " y", "a" * 500, " " * 300 + "z", "a b " * 200]
    raw = [t.encode() for t in texts]
    whole = P.Hasher()(raw)
    for most in (40, 64, 200):
        monkeypatch.setattr(P, "BLOCK", most)
        monkeypatch.setattr(P.blocks_of, "__defaults__", (most,))
        got = P.Hasher()(raw)
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()


def test_hot_and_null_ids_are_split_and_keep_all_rows(spark):
    rows = [(None, prose(i, 12)) for i in range(60)] + [(7, prose(100 + i, 12)) for i in range(50)] + [(i, prose(200 + i, 12)) for i in range(8, 30)] + [(-3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = P.edited_fingerprints(df, 8, hot_rows=10).collect()
    edits = Counter(r["edited_sha256"] for r in got)
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in rows)
    # Cold ids follow each other as ever; the rows of a hot id are each followed by another of it, but for one.
    by_id = {k: [t or "" for i, t in rows if i == k] for k, _ in rows}
    order = [None, -3, 7, *range(8, 30)]
    for k, after in zip(order, [*order[1:], None]):
        own = [r for r in got if r["doc_id"] == k]
        inside = {hashlib.sha256(P.edited(a, b).encode()).hexdigest() for a in by_id[k] for b in by_id[k]}
        across = {hashlib.sha256(P.edited(a, b).encode()).hexdigest() for a in by_id[k] for b in by_id[after]}
        assert all(r["edited_sha256"] in inside | across for r in own)
        assert sum(r["edited_sha256"] not in inside for r in own) <= 1
    assert sum(edits.values()) == len(rows)
