import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docgrain.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = K.Words(open(PATH, encoding="utf-8").read(), most=300)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aAbÉéİßΣς.,!?'_ \n\t\x1c\x85\xa0 01中😀́​", "don't ", "it's", "<|endoftext|>", ", ", ". ", "!, "]), max_size=40).map("".join))
def test_ids_are_the_librarys(text):
    (ids, ends), = WORDS.encode([text])
    expected = LIBRARY.encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert all(0 < e < len(expected) for e in ends.tolist()) or not len(ends)


def cost_of(cut, penalty, size):
    total = sum(penalty[c] for c in cut[1:])
    for a, b in zip(cut, cut[1:]):
        n = b - a
        short = n in K.POWERS and n < size
        total += min(K.SHORT, size - n) if short else size - n
    return total


def test_cuts_cost_least_against_all_ways():
    r = random.Random(2)
    for _ in range(200):
        size = r.choice([5, 8, 20])
        places = [0]
        while len(places) < r.randint(2, 10):
            places.append(places[-1] + r.randint(1, size))
        penalty = dict(zip(places, [0, *(r.choice([0, 3, 8]) for _ in places[1:])]))
        got = K.cuts(places, [penalty[p] for p in places], size)
        best = min(cost_of(c, penalty, size) for n in range(len(places)) for mid in itertools.combinations(places[1:-1], n) for c in [[0, *mid, places[-1]]] if all(b - a <= size for a, b in zip(c, c[1:])))
        assert got[0] == 0 and got[-1] == places[-1] and cost_of(got, penalty, size) == best


def checked(rows, docs):
    """docs: key to ids. Every id in one piece, sequences gapless and not too long."""
    by, seq = {}, {}
    for key, start, length, crc, n, s, offset in rows:
        by.setdefault(key, []).append((start, length, crc, n))
        seq.setdefault(s, []).append((offset, length))
    assert set(by) == set(docs)
    for key, ids in docs.items():
        at = 0
        for start, length, crc, n in sorted(by[key]):
            assert start == at and length > 0 and n == len(ids) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= K.SIZE
        padding += 0 if at & (at - 1) == 0 else K.SIZE - at
    return padding / max(1, sum(map(len, docs.values())))


def test_streams_in_blocks_and_long_documents():
    r = random.Random(3)
    docs = {i: list(range(r.choice([1, 5, 300, 9000]))) or [0] for i in range(200)}
    stream = ((k, np.array(v, "<u4").tobytes(), np.arange(r.randint(5, 40), len(v), r.randint(20, 40))) for k, v in docs.items())
    assert checked(list(K.pack(stream, block=5000)), docs) < 0.05


def test_packed_table(spark, clashing, no_docs):
    plain = clashing.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [tuple(x) for x in K.packed(plain, PATH).select("doc_id", *K.RESULT).collect()]
    texts = {x["doc_id"]: x["text"] or "" for x in plain.collect()}
    checked(rows, {k: LIBRARY.encode(t, add_special_tokens=False).ids + [1] for k, t in texts.items()})
    whole = K.packed(clashing, PATH)
    assert whole.agg({"length": "sum"}).first()[0] > sum(x[2] for x in rows)  # repeated rows and null ids are packed too
    assert K.packed(no_docs, PATH).count() == 0
