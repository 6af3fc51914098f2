import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from docgrain.llm import ctw as C

from .conftest import prose


def test_keys_hold_contexts_last_byte_first():
    got = C.gram_keys([b"ab", b"", b"c"], 2)
    expect = [(10, 10, b"a"), (97, 10, b"b"), (98, 97, b"\n"), (10, 10, b"\n"), (10, 10, b"c"), (99, 10, b"\n")]
    assert got.tolist() == [a << 16 | b << 8 | s[0] for a, b, s in expect]


def test_counter_counts_whatever_fits():
    r = np.random.default_rng(1)
    counter, total = C.GramCounter(bits=6, most_beside=50), Counter()
    for _ in range(20):
        keys = r.integers(0, 300, 400).astype(np.uint64)
        total.update(keys.tolist())
        if (over := counter.add(keys)) is not None:
            total.subtract(dict(zip(over[0].tolist(), over[1].tolist())))
    keys, counts = counter.rest()
    for k, n in zip(keys.tolist(), counts.tolist()):
        total[k] -= n
    assert not any(total.values())


def kt(a, b):
    p = Fraction(1)
    for i in range(a):
        p *= Fraction(2 * i + 1, 2 * (i + 1))
    for j in range(b):
        p *= Fraction(2 * j + 1, 2 * (a + j + 1))
    return p


def test_kt_and_gamma():
    for a, b in [(0, 0), (1, 0), (3, 5), (40, 2)]:
        assert abs(float(C.log_kt(np.array([float(a)]), np.array([float(b)]))[0]) - math.log(kt(a, b))) < 1e-9


def plain_log10(grams, counts, depth, gram):
    """By recursion over strings of bits, exact: the mixture of all depths at each of the eight decisions."""

    def numbers(d, context, node):
        zero = one = 0
        for g, n in zip(grams, counts):
            if g[:d] == context:
                path = 256 | g[-1]
                for k in range(8):
                    if path >> (8 - k) == node:
                        if g[-1] >> (7 - k) & 1:
                            one += n
                        else:
                            zero += n
        return zero, one

    def weighted(d, context, node):
        a, b = numbers(d, context, node)
        if d == depth:
            return kt(a, b)
        inner = Fraction(1)
        for nxt in {g[d] for g in grams if g[:d] == context}:
            inner *= weighted(d + 1, (*context, nxt), node)
        return (kt(a, b) + inner) / 2

    total = 0.0
    for k in range(8):
        node, bit = (256 | gram[-1]) >> (8 - k), gram[-1] >> (7 - k) & 1
        p = None
        for d in range(depth, -1, -1):
            a, b = numbers(d, gram[:d], node)
            if a + b == 0:
                continue
            own = Fraction(2 * b + 1, 2 * (a + b + 1))
            if d == depth:
                p = own
                continue
            w = kt(a, b) / 2 / weighted(d, gram[:d], node)
            p = w * own + (1 - w) * (own if p is None else p)
        p = Fraction(1, 2) if p is None else p
        total += math.log10(p if bit else 1 - p)
    return total


def test_tree_against_plain_recursion():
    depth = 2
    texts = [b"abab abb", b"ba aab", b"cab"]
    keys, counts = np.unique(C.gram_keys(texts, depth), return_counts=True)
    pairs = []
    for d in range(depth + 1):
        short = (keys >> np.uint64(8 * (depth - d + 1))) << np.uint64(8) | (keys & np.uint64(255))
        k, at = np.unique(short, return_inverse=True)
        pairs.append((k, np.bincount(at, counts).astype(np.int64)))
    tree = C.Tree.built(depth, pairs)
    grams = [tuple(int(k) >> 8 * (depth - i) & 255 for i in range(depth)) + (int(k) & 255,) for k in keys]
    asked = np.array(sorted({*keys.tolist(), 97 << 16 | 97 << 8 | 99, 122 << 16 | 97 << 8 | 98, 98 << 16 | 122 << 8 | 97}), np.uint64)
    got = tree.log10(asked)
    for k, g in zip(asked.tolist(), got):
        gram = (k >> 16 & 255, k >> 8 & 255, k & 255)
        assert abs(g - plain_log10(grams, counts.tolist(), depth, gram)) < 1e-5, gram


def test_probabilities_of_all_bytes_sum_to_one():
    keys, counts = np.unique(C.gram_keys([prose(1, 500).encode()], 3), return_counts=True)
    pairs = []
    for d in range(4):
        short = (keys >> np.uint64(8 * (4 - d))) << np.uint64(8) | (keys & np.uint64(255))
        k, at = np.unique(short, return_inverse=True)
        pairs.append((k, np.bincount(at, counts).astype(np.int64)))
    tree = C.Tree.built(3, pairs)
    for context in (0, int(keys[5]) >> 8, int(keys[50]) >> 8, 0x7A7A7A):
        every = np.array([context << 8 | b for b in range(256)], np.uint64)
        assert abs((10 ** tree.log10(every)).sum() - 1) < 1e-4


@pytest.mark.parametrize("top", [3, 10**6])
def test_scores_against_plain_base(spark, clashing, top):
    more = spark.createDataFrame([(200 + i, prose(i % 30, 60)) for i in range(60)], "doc_id long, text string")
    df = clashing.select("doc_id", "text").union(more)
    rows = [(r["doc_id"], C.words_of(r["text"] or "") + [b"\n"]) for r in df.collect()]
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1
    c = Counter(w for k, ws in rows if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted(((k, held(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for k, ws in rows), key=str)
    got = C.scores(df, depth=5, most_pairs=100_000, top=top).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == expected
    assert all(r["score"] < 0 for r in got)
    known = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 200]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)


def test_empty_tables(spark, no_docs):
    assert C.scores(no_docs).count() == 0
    one = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    got = C.scores(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()  # nothing to learn from
    assert got["train_tokens"] == 0 and got["n_known"] == 0 and got["base_score"] == 0 and abs(got["score"] - 4 * 8 * math.log10(0.5)) < 1e-6


def test_merged_counts():
    r = np.random.default_rng(2)
    parts = [(np.unique(r.integers(0, 50, 20).astype(np.uint64)), None) for _ in range(6)]
    parts = [(k, r.integers(1, 9, len(k))) for k, _ in parts]
    total = Counter()
    for k, n in parts:
        total.update(dict(zip(k.tolist(), n.tolist())))
    keys, counts = C.merged_counts(parts)
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(total) and keys.tolist() == sorted(keys.tolist())


@pytest.mark.parametrize("most_pairs", [5, 10**6])
def test_every_counted_context_is_in_the_model(spark, most_pairs):
    # Rows whose grams are far more than most_pairs score as by one tree of all counts, on whatever shards.
    rows = [(i, prose(i, 30)) for i in range(40)]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    joined = {k: b" ".join(C.words_of(t)) for k, t in rows}
    for depth in (2, 5):
        keys, counts = np.unique(C.gram_keys([t for k, t in joined.items() if not held(k)], depth), return_counts=True)
        pairs = []
        for d in range(depth + 1):
            short = (keys >> np.uint64(8 * (depth - d + 1))) << np.uint64(8) | (keys & np.uint64(255))
            k, at = np.unique(short, return_inverse=True)
            pairs.append((k, np.bincount(at, counts).astype(np.int64)))
        tree = C.Tree.built(depth, pairs)
        got = C.scores(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, most_pairs=most_pairs).collect()
        for r in got:
            assert abs(r["score"] - tree.log10(C.gram_keys([joined[r["doc_id"]]], depth)).sum()) < 1e-2, r


@pytest.mark.parametrize("depth", [0, 2])
def test_huge_counts_leave_every_byte_a_probability(depth):
    # One byte seen four thousand million times after one context: the others are rare, and not impossible.
    gram = lambda context, byte: np.uint64((context & ((1 << 8 * depth) - 1)) << 8 | byte)
    keys, counts = np.array(sorted([gram(0x6161, 97), gram(0x6162, 98)]), np.uint64), None
    keys = np.unique(keys)
    counts = np.where(keys == gram(0x6161, 97), 4_000_000_000, 7)
    tree = C.Tree.built(depth, [C.shorter(keys, counts, depth, d) for d in range(depth + 1)])
    for context in (0x6161, 0x6162, 0x7A7A):
        logs = tree.log10(np.array([gram(context, b) for b in range(256)], np.uint64))
        assert np.isfinite(logs).all() and abs((10**logs).sum() - 1) < 1e-5
    rare = tree.log10(np.array([gram(0x6161, 200)], np.uint64))[0]
    assert -40 < rare < -8
