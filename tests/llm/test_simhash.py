import random

import numpy as np
import pytest
import xxhash

from docgrain.llm import simhash as S

from .conftest import prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius):
    """values: distinct (name, bits); name to least name reachable."""
    parent = {n: n for n, _ in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(values):
        for b, y in values[:i]:
            if (x ^ y).bit_count() <= radius:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {n: find(n) for n, _ in values}


def test_fingerprint_is_the_plain_one():
    for t in [None, "", " ", "A", "a b c", "A b C d", prose(3, 5), prose(4, 400), "É x É x É x"]:
        assert S.fingerprint(t or "") == plain_fingerprint(t)


def clustered(n, seed, spread):
    """Random 64-bit numbers, many of them within a few bits of others."""
    r = random.Random(seed)
    out = set()
    centres = [r.getrandbits(64) for _ in range(max(1, n // 20))]
    while len(out) < n:
        x = r.choice(centres)
        for _ in range(r.randint(0, spread)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("block", [20_000, 7])
def test_links_join_the_same_components_as_all_pairs(spark, block):
    values = list(enumerate(clustered(600, block, 7)))
    signed = [(n, x - (1 << 64) if x >> 63 else x) for n, x in values]
    df = spark.createDataFrame([(n, [x]) for n, x in signed], "name long, dg_w array<bigint>")
    found = {r["name"]: r["root"] for r in S.components(S.links(df, block=block)).collect()}
    expected = brute_components(values, 4)
    assert {n: found.get(n, n) for n, _ in values} == expected
    assert len(set(expected.values())) < 500


def test_walk_makes_few_links_of_a_dense_cluster():
    fp = np.array(clustered(400, 1, 3) + [1 << i for i in range(64)] + [0], np.uint64)[:, None]
    a, b = S.walk(fp, 4)
    assert len(a) < len(fp)


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 502), (500, 502)], "a long, b long")
    got = {r["name"]: r["root"] for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500}


def test_classes_against_brute_force(spark, clashing, no_docs):
    rows = clashing.select("doc_id", "text").collect()
    near = [(50 + i, prose(7, 300) + f" tail{i}") for i in range(6)]
    df = clashing.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    bits = sorted({x for _, x in rows})
    root = brute_components(list(enumerate(bits)), 4)
    least = {}
    for k, x in rows:
        c = root[bits.index(x)]
        if k is not None:
            least[c] = min(least.get(c, k), k)
    got = S.classes(df).collect()
    assert sorted(((r["doc_id"], r["dg_fp"] % 2**64, r["component_id"]) for r in got), key=str) == sorted(((k, x, least.get(root[bits.index(x)])) for k, x in rows), key=str)
    assert S.classes(no_docs).count() == 0


def test_one_of_each_class_stays(spark, clashing, no_docs):
    out = S.first_of_classes(clashing)
    assert out.columns == clashing.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 5 in ids and 6 not in ids and 3 in ids and 4 not in ids and 0 in ids and 1 not in ids and None in ids
    assert S.first_of_classes(no_docs).count() == 0
    base = prose(9, 250).split(" ")
    copies = []
    for i in range(12):  # one word in fifty changed
        words = base[:]
        words[(i * 19) % 250] = f"changed{i}"
        words[(i * 19 + 125) % 250] = f"other{i}"
        copies.append((i, " ".join(words)))
    df = spark.createDataFrame(copies + [(100 + i, prose(20 + i, 200)) for i in range(10)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.first_of_classes(df).collect()) == [0, *range(100, 110)]


def test_classes_without_ids_or_of_one_id_each_keep_a_row(spark):
    texts = [prose(40 + i, 120) for i in range(8)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (7, texts[5]), (7, texts[6]), (8, texts[6]), (9, texts[7])]
    got = S.first_of_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, t) for t in texts[:5]] + [(7, texts[5]), (7, texts[6]), (9, texts[7])], key=str)


def plain_runs(t):
    return frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4)))


def plain_alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def copies_of_all_likenesses():
    rows, expected = [], []
    for i in range(150):  # pairs of copies, about 0.7 to 0.95 alike
        base = [f"w{i}x{k}" for k in range(200)]
        other = base[:]
        for k in range(1 + i % 7):
            other[10 + 25 * k] = "changed"
        a, b = " ".join(base), " ".join(other)
        rows += [(2 * i, a), (2 * i + 1, b)]
        expected += [2 * i] if plain_alike(plain_runs(a), plain_runs(b)) else [2 * i, 2 * i + 1]
    return rows, expected


def test_exact_filter_links_all_texts_of_likeness_from_four_fifths(spark):
    rows, expected = copies_of_all_likenesses()
    got = S.first_of_classes(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).collect()
    assert 150 < len(expected) < 300 and sorted(r["doc_id"] for r in got) == expected


def test_filter_links_no_other_texts_and_nearly_all_of_these(spark):
    rows, expected = copies_of_all_likenesses()
    kept = {r["doc_id"] for r in S.first_of_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(expected) <= kept  # what is less alike stays
    alike = {2 * i + 1 for i in range(150)} - set(expected)
    assert len(alike) > 80 and len(alike - kept) >= 0.98 * len(alike)


def test_planned_segments_meet_at_every_likeness():
    # By brute force on the fingerprints themselves, over random sets of a given likeness.
    r = np.random.default_rng(4)
    for n, alike in ((1000, 0.8), (10**6, 0.8), (10**6, 0.9)):
        segments, words = S.planned(n)
        met, near, trials = 0, 0, 150
        for _ in range(trials):
            size = 120
            shared = round(2 * size * alike / (1 + alike))
            both = r.integers(0, 2**63, 2 * size - shared).astype(np.uint64)
            a, b = S.wide_fingerprint(np.sort(both[:size]), words), S.wide_fingerprint(np.sort(both[size - shared :]), words)
            met += any(int(a[w] ^ b[w]) >> low & ((1 << m) - 1) in {0, *(1 << k for k in range(m))} for w, low, m in segments)
            near += int(np.bitwise_count(a[:2] ^ b[:2]).sum()) <= S.CHECKED_BITS
        assert met >= 0.95 * trials and near >= 0.99 * trials
        assert all(low + m <= 64 and w < words for w, low, m in segments)


def test_filter_in_blocks_and_of_a_large_cluster(spark):
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):  # near copies of one text, each by a word of its own
        words = base[:]
        words[(7 * i) % 150] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(500 + i, 90)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = {k: plain_runs(t) for k, t in rows}
    found = S.alike_classes(df, ["doc_id"], 5, "doc_id", "text", block=20).collect()
    named = {}
    for x in found:
        named.setdefault(x["dg_class"], set()).add(x["doc_id"])
    assert sorted(map(len, named.values())) == [1] * 40 + [300]
    assert plain_alike(runs[0], runs[1])
