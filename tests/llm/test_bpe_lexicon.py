import cProfile
import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docgrain.llm import bpe_lexicon as B
from docgrain.llm.common import mapped_file

from .conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)
VOCABULARY = B.Vocabulary(SPEC)
PLAIN = B.Encoder(VOCABULARY, None)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from([*"ab'tsr  ,.\n\t\x1c\x85\xa0　01é́中😀", "<|endoftext|>", "'re", "  ", "word", " Wörd,", " end."]), max_size=40).map("".join))
def test_ids_and_texts_are_the_librarys(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert PLAIN.encode(text) == expected
    assert B.decode(VOCABULARY, expected) == LIBRARY.decode(expected, skip_special_tokens=False)


def test_long_words_and_lone_bytes():
    for text in ("ab" * 3000 + "aaaaa" * 200, "the" * 100, "é" * 500, " " * 300 + "x"):
        assert PLAIN.encode(text) == LIBRARY.encode(text).ids
    assert B.decode(VOCABULARY, [255, 100]) == LIBRARY.decode([255, 100], skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(max_size=5), st.lists(st.integers(0, 50_000), max_size=4), max_size=30), st.lists(st.binary(max_size=5), max_size=20))
def test_lexicon_is_a_map(tmp_path_factory, entries, others):
    path = tmp_path_factory.mktemp("lex") / "l.bin"
    path.write_bytes(B.compile_lexicon(list(entries.items())))
    lexicon = B.Lexicon(mapped_file(str(path)))
    assert len(lexicon) == len(entries)
    for w, ids in entries.items():
        assert lexicon.get(w) == ids
    for w in others:
        if w not in entries:
            assert lexicon.get(w) is None
    assert lexicon.get_many([*entries, *others]) == [lexicon.get(w) for w in [*entries, *others]]


def test_lexicon_shares_endings(tmp_path):
    words = [a + b for a in (b"w", b"t", b"s") for b in (b"alking", b"alked", b"alks")]
    blob = B.compile_lexicon([(w, [1]) for w in words])
    (tmp_path / "l").write_bytes(blob)
    lexicon = B.Lexicon(mapped_file(str(tmp_path / "l")))
    arcs = len(lexicon.targets)
    assert arcs == 3 + 3 + len(b"ies") + len(b"ng") + 1  # one way in each of: first letter, alk, what follows, its rest


def test_table_with_and_without_lexicon(spark, clashing, no_docs):
    more = spark.createDataFrame([(300 + i, prose(i, 100) + " <|endoftext|> end") for i in range(20)], "doc_id long, text string")
    df = clashing.select("doc_id", "text").union(more)
    for words in (0, 5, 1000):
        got = B.encoded(df, PATH, words, with_ids=True).collect()
        assert len(got) == df.count()
        by = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=str)
        expected = []
        for r in df.collect():
            ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
            expected.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert by == sorted(expected, key=str)
        assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert B.encoded(no_docs, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12) | st.text("abthein ", min_size=1, max_size=30), max_size=60), st.booleans())
def test_words_merged_together_are_those_merged_apart(words, repeat):
    raw = [w.encode("utf-8", "surrogatepass") for w in words * (12 if repeat else 1)]
    assert VOCABULARY.merge_many(raw) == [VOCABULARY.merge(w) for w in raw]


def test_encoding_after_in_batches_and_the_lexicon_path(tmp_path):
    texts = [prose(i, 200) + f" end{i}. a,b x\u00a0y\n z <|endoftext|>q" for i in range(60)]
    found = sorted({w.encode() for t in texts[:3] for parts, _ in VOCABULARY.pieces(t) for w in parts})
    (tmp_path / "l").write_bytes(B.compile_lexicon([(w, VOCABULARY.merge(w)) for w in found]))
    encoder = B.Encoder(VOCABULARY, B.Lexicon(mapped_file(str(tmp_path / "l"))), most=300)
    for at in range(0, 60, 20):
        got = [[int(i) for ids, _ in parts for i in ids.split(",")] for parts in encoder.batch(texts[at : at + 20])]
        assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[at : at + 20]]
    assert encoder.from_lexicon > 100 and encoder.merged > 20


def test_frequent_words_are_the_most_frequent(spark):
    from collections import Counter

    texts = [prose(i, 300) for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = Counter(w for t in texts for w in t.split(" ") if w)
    got = B.frequent_words(df, SPEC, 40)
    pieces = Counter()
    for w, n in counts.items():
        if n >= sorted(counts.values())[-40]:
            for p, _ in VOCABULARY.pieces(" " + w):
                for x in p:
                    pieces[x] += n
    assert got and set(got) <= set(pieces) and len(got) <= 40
    assert B.frequent_words(df, SPEC, 0) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.lists(st.sampled_from([*"ab'tsr  ,.\n\t\x1c\x85\xa001é中😀", "<|endoftext|>", "'re", "  ", " word", " Wörd,", " end."]), max_size=30).map("".join), max_size=8))
def test_a_batch_is_as_each_text(texts):
    got = [[int(i) for ids, _ in parts for i in ids.split(",")] for parts in B.Encoder(VOCABULARY, None, most=12).batch(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_and_known_words_cost_no_calls_each():
    """Calls of functions stand for CPU seconds, which a test can't hold still: 19 for each new word before, from which the budget was missed."""
    dice = random.Random(5)
    words = ["".join(dice.choices("abdeghinorstué", k=dice.randint(6, 12))) for _ in range(20_000)]
    texts = [" ".join(words[i : i + 100]) + ", " + " ".join(words[:100]) + "." for i in range(0, len(words), 100)]
    encoder, seen = B.Encoder(VOCABULARY, None), cProfile.Profile()
    got = seen.runcall(encoder.batch, texts)
    assert [[int(i) for ids, _ in parts for i in ids.split(",")] for parts in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    calls = sum(x.callcount for x in seen.getstats())
    assert calls < len(words)


def test_what_is_kept_is_bounded_and_right():
    dice = random.Random(6)
    encoder = B.Encoder(VOCABULARY, None, most=40)
    for _ in range(12):
        texts = [" ".join(dice.choice(["", "\n", "\x1c", "a,", "b's", "Wört", "x\n\ny", "<|endoftext|>", "é" * 70, str(dice.randrange(99))]) if dice.random() < 0.2 else f"w{dice.randrange(200)}" for _ in range(dice.randrange(30))) for _ in range(20)]
        got = [[int(i) for ids, _ in parts for i in ids.split(",")] for parts in encoder.batch(texts)]
        assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.met.now) <= 40 and len(encoder.met.then) <= 40
