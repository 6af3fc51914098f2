"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines with a word). Each paragraph is hashed to a wide vector, and the vectors
are added, each coordinate modulo a power of two:

* 4 words of 64 bits from BLAKE2b of the paragraph, modulo 2^64: equal multisets have equal sums, and other multisets
  meet only by chance. They decide equality.
* 256 signed counters modulo 2^24: each run of SHINGLE words of the paragraph adds +1 or -1 to one counter by its hash.
  Their inner products estimate those of the multisets of word runs, and so a likeness.

Sums don't depend on the order of paragraphs. A paragraph is inserted or deleted by adding or subtracting its vector
(`insert`, `delete`), without the rest of the text.

A null or empty text has the zero vector. Texts are read whole. Ties, repeated rows and further columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import quantile_bounds, ship, shuffle_width, small_batches

EXACT, WIDE, SHINGLE = 4, 256, 3
MODULUS = 1 << 24
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes of text that are counted at a time, one word at least.
BLOCK = 4 << 20
WORD = re.compile(rb"[^\t-\r ]+")


def blocks_of(text: bytes, most: int = BLOCK):
    """A text in blocks that together have its runs of words, each once: whole lines, or parts of a longer line that share SHINGLE - 1 words."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(b"\n", at, at + most) + 1
        if end:
            yield text[at:end]
            at = end
            continue
        stop = text.find(b"\n", at + most)
        stop = len(text) if stop < 0 else stop
        starts, words, before = deque(maxlen=SHINGLE - 1), 0, at
        for word in WORD.finditer(text, at, stop):
            if before - at > most and words >= SHINGLE:
                yield text[at:before]
                at, words = starts[0], SHINGLE - 1
            starts.append(word.start())
            words, before = words + 1, word.end()
        yield text[at:stop]
        at = stop
    yield text[at:]


class Hasher:
    """Fingerprints of many texts at once; holds the powers it has needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = powers(n, BASE), powers(n, INVERSE)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, EXACT) of 64-bit words and (rows, WIDE) of signed counters."""
        n = len(texts)
        exact, wide = np.zeros((n, EXACT), np.uint64), np.zeros((n, WIDE), np.int64)
        for i, text in enumerate(texts):
            for line in text.split(b"\n"):
                if line := line.strip():
                    exact[i] += np.frombuffer(hashlib.blake2b(line, digest_size=8 * EXACT).digest(), "<u8")
        # Counters add up, so long texts are counted in blocks: what a call holds does not grow with a text.
        held, size = [], 0
        for i, text in enumerate(texts):
            for block in blocks_of(text):
                held.append((i, block))
                size += len(block)
                if size > BLOCK:
                    self.count(held, wide)
                    held, size = [], 0
        if held:
            self.count(held, wide)
        return exact, (wide + MODULUS // 2) % MODULUS - MODULUS // 2

    def count(self, held: list[tuple[int, bytes]], wide: np.ndarray) -> None:
        """Adds the runs of words of (row, bytes) to the rows' counters."""
        texts, rows = [t for _, t in held], np.array([i for i, _ in held])
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.grow(len(raw) + 1)
        space = SPACE[raw]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * self.down[starts])
        lines = np.cumsum(raw == 10)[starts]  # a word holds no line end
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        doc = rows[np.searchsorted(first, starts, side="right") - 1]
        h = words.copy()
        m = len(words)
        whole = np.ones(m, bool)  # runs of SHINGLE words; a shorter line is one run
        position = np.arange(m)
        new = np.concatenate(([True], lines[1:] != lines[:-1]))
        begin = np.maximum.accumulate(np.where(new, position, 0))
        size = np.diff(np.append(np.flatnonzero(new), m))
        left = begin + np.repeat(size, size) - position  # words from here to the line's end
        for k in range(1, SHINGLE):
            there = left > k
            h[: m - k] = np.where(there[: m - k], mix(h[: m - k] * BASE + words[k:]), h[: m - k])
            whole &= there | (position == begin)
        h, doc = mix(h[whole]), doc[whole]
        sign = 1 - 2 * ((h >> np.uint64(63)).astype(np.int64))
        slot = doc * WIDE + (h & np.uint64(WIDE - 1)).astype(np.int64)
        wide += np.bincount(slot, weights=sign, minlength=wide.size).astype(np.int64).reshape(wide.shape)


def insert(a, b):
    """The fingerprint vectors of both multisets together."""
    return a[0] + b[0], (a[1] + b[1] + MODULUS // 2) % MODULUS - MODULUS // 2


def delete(a, b):
    """The fingerprint vectors of a without the paragraphs of b."""
    return a[0] - b[0], (a[1] - b[1] + MODULUS // 2) % MODULUS - MODULUS // 2


def text_of(exact: np.ndarray, wide: np.ndarray) -> list[str]:
    """Hex: the 64-bit words, then 3 bytes a counter."""
    low = np.ascontiguousarray((wide % MODULUS).astype(">u4")).view(np.uint8).reshape(*wide.shape, 4)[:, :, 1:]
    return [bytes(a).hex() + bytes(b).hex() for a, b in zip(exact.astype(">u8").view(np.uint8).reshape(len(exact), -1), low.reshape(len(wide), -1))]


def vectors_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of one fingerprint's hex."""
    raw = bytes.fromhex(text)
    exact = np.frombuffer(raw[: 8 * EXACT], ">u8").astype(np.uint64)
    low = np.frombuffer(raw[8 * EXACT :], np.uint8).reshape(WIDE, 3).astype(np.int64)
    wide = low[:, 0] << 16 | low[:, 1] << 8 | low[:, 2]
    return exact, (wide + MODULUS // 2) % MODULUS - MODULUS // 2


def likeness(ea, wa, eb, wb) -> np.ndarray:
    """Row by row, from 0 to 1: 1 for equal multisets, else the cosine of the counters, under 1."""
    same = (ea == eb).all(axis=1)
    a, b = wa.astype(np.float64), wb.astype(np.float64)
    dot, size = (a * b).sum(axis=1), np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    near = np.divide(dot, size, out=np.zeros(len(dot)), where=size > 0)
    return np.where(same, 1.0, np.clip(near, 0.0, 1 - 1e-9))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many of the other text, or all it has."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(ids: list, texts: list[str], hasher: Hasher) -> pa.RecordBatch:
    """Rows for all but the last of these texts, each beside the one after it."""
    edits = [edited(a, b) for a, b in zip(texts, texts[1:])]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw_edits = [t.encode("utf-8", "surrogatepass") for t in edits]
    e, w = hasher(raw)
    ee, we = hasher(raw_edits)
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in raw_edits], pa.string()),
        pa.array(text_of(e[:-1], w[:-1]), pa.string()),
        pa.array(text_of(ee, we), pa.string()),
        pa.array(likeness(e[:-1], w[:-1], ee, we)),
        pa.array(likeness(e[:-1], w[:-1], e[1:], w[1:])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each text; no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        hasher = Hasher()
        for batch in small_batches(batches, 4 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(text_of(*hasher([t.encode("utf-8", "surrogatepass") for t in texts])), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


#: Rows of one doc_id, or of none, that are still one range.
HOT_ROWS = 50_000


class Ranges:
    """Ranges of rows by (doc_id, a hash of the text for hot ids), from sorted bounds: null ids first, hot ids in parts by hash.

    ids: bounds, each the least id of a range; hot: parts of each hot id, whose first part begins a range as well; nulls: parts of the null id.
    heads, for each range that has rows: its number, least id and least hash there.
    """

    def __init__(self, ids: list[int], hot: dict[int, int], nulls: int):
        # Hot ids have a bound for each part; the id after one opens a range too.
        self.ids = np.array(sorted([x for x in {*ids, *(h + 1 for h in hot if h < 2**63 - 1)} if x not in hot] + [h for h, k in hot.items() for _ in range(k)]), np.int64)
        self.hot_ids = np.array(sorted(hot), np.int64)
        self.hot_parts = np.array([hot[int(x)] for x in self.hot_ids], np.int64)
        self.nulls, self.heads = nulls, None

    def place(self, ids: pa.Array, hashes: pa.Array) -> pa.StructArray:
        """range, the hash (0 but for hot ids) and, for what opens a range, the range before it (the last for the first)."""
        null = np.asarray(ids.is_null())
        key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tie = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.searchsorted(self.hot_ids, key)
        is_hot = ~null & (self.hot_ids[np.minimum(at, len(self.hot_ids) - 1)] == key) if len(self.hot_ids) else np.zeros(len(key), bool)
        parts = np.where(null, max(1, self.nulls), np.where(is_hot, self.hot_parts[np.minimum(at, len(self.hot_parts) - 1)] if len(self.hot_parts) else 1, 1))
        split = is_hot | null & (self.nulls > 1)
        tie = np.where(split, tie >> np.uint64(1), np.uint64(0)).astype(np.int64)
        part = (tie >> 31) * parts >> 32
        low = np.searchsorted(self.ids, key, side="left")
        high = np.searchsorted(self.ids, key, side="right")
        number = np.where(null, part, self.nulls + np.where(is_hot, low + part + 1, high))
        opens = pa.nulls(len(key), pa.int64())
        if self.heads is not None:
            numbers, head_null, head_id, head_tie = self.heads
            number = np.searchsorted(numbers, number)
            first = (head_null[number] == null) & (null | (head_id[number] == key)) & (head_tie[number] == tie)
            opens = pa.array(np.where(number > 0, number - 1, len(numbers) - 1), pa.int64(), mask=~first)
        return pa.StructArray.from_arrays([pa.array(number, pa.int64()), pa.array(tie), opens], names=["range", "tie", "opens"])


def edited_fingerprints(docs: DataFrame, parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next text by (doc_id, text); the last is followed by the first.

    Rows are dealt once, by ranges of doc_id, as many as the input has splits or more, each to a task of its own. The first row of each
    range also goes to the end of the range before it, so that every row meets the one after it without another pass. A null
    doc_id comes first. An id of more than hot_rows rows and of more than a range's share (the null id too) is cut into ranges by a hash of
    the text, and its rows follow each other by that hash; so no range grows with an id, but for rows that repeat both id and text.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or max(shuffle_width(spark), docs.rdd.getNumPartitions())
    total = docs.count()
    share = max(1, -(-total // parts))
    often = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(hot_rows, share)).collect()  # parts rows at most
    some_null = docs.where("doc_id is null").limit(1).count()
    pieces = {x["doc_id"]: -(-x["n"] // share) for x in often}
    ranges = Ranges(quantile_bounds(docs, "doc_id", parts), {k: n for k, n in pieces.items() if k is not None}, pieces.get(None, some_null))

    def placed(held):
        @arrow_udf("struct<range: bigint, tie: bigint, opens: bigint>")
        def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
            return held.value.place(ids, hashes)

        return docs.withColumn("to", place("doc_id", F.xxhash64("text")))

    # The least key of each range that has rows opens it.
    heads = placed(spark.sparkContext.broadcast(ranges)).groupBy("to.range").agg(F.min(F.struct("doc_id", "to.tie")).alias("head")).select("range", "head.*").orderBy("range").collect()
    ranges.heads = (np.array([x["range"] for x in heads], np.int64), np.array([x["doc_id"] is None for x in heads], bool), np.array([x["doc_id"] or 0 for x in heads], np.int64), np.array([x["tie"] for x in heads], np.int64))
    own = placed(spark.sparkContext.broadcast(ranges))
    both = F.filter(F.array(F.struct(F.col("to.range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("to.opens").alias("r"), F.lit(1).alias("guest"))), lambda x: x["r"].isNotNull())
    own = own.select("doc_id", "text", F.col("to.tie").alias("tie"), F.explode(both).alias("at")).select("doc_id", "text", "tie", F.col("at.r").cast("int").alias("range"), F.col("at.guest").alias("guest"))
    dealt = own.repartitionById(max(1, len(heads)), "range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text", "range", "guest")

    def run(batches):
        hasher, held, done = Hasher(), None, set()
        for batch in small_batches(batches, 4 << 20):
            ids, texts, ranges, guests = (c.to_pylist() for c in batch.columns)
            a = 0
            while a < len(ids):
                b = a
                while b < len(ids) and ranges[b] == ranges[a]:
                    b += 1
                at = next((i for i in range(a, b) if guests[i]), b)  # after the first guest, the range is over
                if ranges[a] not in done:
                    stop = min(b, at + 1)
                    run_ids, run_texts = ids[a:stop], texts[a:stop]
                    if held and held[0] == ranges[a]:
                        run_ids, run_texts = [held[1], *run_ids], [held[2], *run_texts]
                    if len(run_ids) > 1:
                        yield compare(run_ids, run_texts, hasher)
                    if at < b:
                        done = {ranges[a]}
                    held = (ranges[a], run_ids[-1], run_texts[-1])
                a = b

    return dealt.mapInArrow(run, RESULT)
