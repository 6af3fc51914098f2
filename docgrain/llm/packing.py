"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of an input partition, in the order of its rows, are one stream of tokens. It is cut into windows of at most
SIZE tokens so that the sum of padding and of penalties for cuts inside documents is least. Cuts stand at document ends
(free), at sentence or line ends (CUT_SENTENCE) or, where those are further apart than a window, anywhere (CUT_ANYWHERE).
With f(j) the least cost of a stream that ends at cut j and p(j) its place,

    f(j) = penalty(j) + min over i, p(j) - p(i) <= SIZE, of f(i) + SIZE - (p(j) - p(i))

and the minimum of f(i) + p(i) over a sliding window comes from a monotone queue, so that a stream takes linear time.
Windows whose length is a smaller power of two need no padding; they cost SHORT instead. The stream is solved in blocks of
BLOCK tokens, each of which hands its last windows on to the next, so that memory is bounded. What is left at the end of a
partition is cut into powers of two.

Partitions are packed apart and nothing is shuffled. A sequence's id has the partition in its upper half; a partition that
is computed again gives the same ids. Null and empty texts have the end token alone. Repeated rows are packed each.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, ship, small_batches

SIZE = 2048
CUT_SENTENCE, CUT_ANYWHERE, SHORT = 8, 64, 12
BLOCK = 1 << 20
END_ID = 1
POWERS = (1024, 512, 256)
STOPS = ".!?…。！？"
CLOSERS = "\"'”’»)]"
#: Python's split() takes these for white space, the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A full stop or comma that belongs to a run of marks, which must not be cut.
IN_RUN = re.compile(r"[.,](?:(?<=[^\w\s].)|(?<=_.))")
#: Characters other than those that stay letters, digits or marks when the tokenizer composes and lower-cases them.
EXOTIC = re.compile("[^\0-\u012f\u0131-\u024f\u2010-\u2027\u4e00-\u9fff]")
#: Words of these letters only are one piece to the pre-tokenizer, and stay so in lower case.
PLAIN = re.compile("[a-zA-Z\xe0-\xf6\xf8-\xff]+")


class Words:
    """Token ids of texts by a tokenizers JSON that drops white space: words are encoded once and looked up after that."""

    def __init__(self, tokenizer_json: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_padding()
        self.library.no_truncation()
        suffix = json.loads(tokenizer_json)["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Whether an id ends a word; none does if words have no marked ends.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.most = most
        self.clear()

    def clear(self) -> None:
        words = self

        class Place(dict):
            """Numbers of words; one that is new gets the next number, and waits to be encoded."""

            def __missing__(self, word: str) -> int:
                n = self[word] = len(self)
                words.new.append(word)
                return n

        self.place, self.new, self.known = Place(), [], 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0  # ids of all words, one after another
        self.first, self.size, self.stop = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one after another, and how many each has. Plain ones are encoded as one text, whose ids are cut where words end."""
        plain = np.array([PLAIN.fullmatch(w) is not None for w in words], bool)
        parts, sizes = [], np.zeros(len(words), np.int64)
        for at in range(0, len(words), 2000):
            mine = slice(at, at + 2000)
            if plain[mine].all():
                ids = np.array(self.library.encode_batch_fast([" ".join(words[mine])], add_special_tokens=False)[0].ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(words[mine]) and last[-1] == len(ids) - 1:
                    parts.append(ids)
                    sizes[mine] = np.diff(last, prepend=-1)
                    continue
            for i, code in enumerate(self.library.encode_batch_fast(words[mine], add_special_tokens=False), at):
                parts.append(np.array(code.ids, np.uint32))
                sizes[i] = len(parts[-1])
        return np.concatenate(parts), sizes

    def learn(self) -> None:
        """Encode the words that wait."""
        if not self.new:
            return
        order = sorted(range(len(self.new)), key=lambda i: PLAIN.fullmatch(self.new[i]) is None)  # plain ones first
        words = [self.new[i] for i in order]
        ids, sizes = self.ids_of(words)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.size) < len(self.place):
            self.first, self.size, self.stop = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size, self.stop))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.array(order) + self.known
        self.first[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.stop[at] = [w[-1] in STOPS or w[-1] in CLOSERS and w.rstrip(CLOSERS)[-1:] in STOPS and w.rstrip(CLOSERS) != "" for w in words]
        self.used += len(ids)
        self.known, self.new = len(self.place), []

    def split(self, text: str) -> tuple[list[str], list[int]] | None:
        """Words, and how many there are at each line's end. None if the text must be encoded whole."""
        if ODD_SPACE.search(text):
            return None
        if text.isascii():
            text = text.lower()
            cut = not IN_RUN.search(text)
        else:
            cut = not EXOTIC.search(text) and not IN_RUN.search(text)
        if cut:  # marks after a word are words of their own, so that fewer are met
            text = text.replace(", ", " , ").replace(". ", " . ")
        words, ends = [], []
        for line in text.split("\n"):
            if cut and line[-1:] in (".", ","):
                line = f"{line[:-1]} {line[-1]}"
            words += line.split()
            ends.append(len(words))
        return words, ends

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text the ids with the end token, as little-endian 32-bit numbers, and the places of sentence ends, as counts of ids before."""
        out: list = []
        for at in range(0, len(texts), 256):
            if len(self.place) > self.most:
                self.clear()
            found = []
            for text in texts[at : at + 256]:
                split = self.split(text)
                found.append(split and (np.fromiter(map(self.place.__getitem__, split[0]), np.int64, len(split[0])), split[1]))
            self.learn()
            out += [self.looked_up(*x) if x else self.whole(text) for x, text in zip(found, texts[at:])]
        return out

    def looked_up(self, words: np.ndarray, ends: list[int]) -> tuple[bytes, np.ndarray]:
        size = self.size[words]
        after = np.cumsum(size)
        n = int(after[-1]) if len(after) else 0
        ids = np.empty(n + 1, "<u4")
        ids[:n] = self.flat[np.repeat(self.first[words] - (after - size), size) + np.arange(n)]
        ids[n] = END_ID
        stop = self.stop[words]
        stop[[e - 1 for e in ends if e]] = True
        return ids.tobytes(), after[stop]

    def whole(self, text: str) -> tuple[bytes, np.ndarray]:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END_ID], "<u4").tobytes(), np.zeros(0, np.int64)


def cuts(places: list[int], penalties: list[int], size: int = SIZE) -> list[int]:
    """The places, out of ascending ones from 0 on, at which a stream is cut at least cost; the first and last always are."""
    n = len(places)
    place = np.array(places)
    shorter: dict[int, list[int]] = {}  # of a cut, those that stand a smaller power of two before it
    for q in POWERS:
        if q < size:
            at = np.searchsorted(place, place - q)
            for j in np.flatnonzero(place[at] == place - q).tolist():
                shorter.setdefault(j, []).append(int(at[j]))
    key, back, cost = [0] * n, [0] * n, [0] * n  # key: cost + place
    queue, head, none = [0], 0, ()
    for j in range(1, n):
        p = places[j]
        low = p - size
        while places[queue[head]] < low:
            head += 1
        i = queue[head]
        best = key[i] + size - p
        for k in shorter.get(j, none):
            if cost[k] + SHORT < best:
                best, i = cost[k] + SHORT, k
        best += penalties[j]
        cost[j], back[j] = best, i
        key[j] = best = best + p
        while len(queue) > head and key[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    out, j = [places[n - 1]], n - 1
    while j:
        j = back[j]
        out.append(places[j])
    return out[::-1]


def candidates(docs: list[tuple[int, np.ndarray]], size: int = SIZE) -> tuple[list[int], list[int]]:
    """Places and penalties of the cuts of documents given as (tokens, sentence ends), laid one after another; no gap is over size."""
    at, parts, costs = 0, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for n, ends in docs:
        inner = np.unique(ends[(ends > 0) & (ends < n)])
        parts += [inner + at, np.array([at + n])]
        costs += [np.full(len(inner), CUT_SENTENCE), np.zeros(1, np.int64)]
        at += n
    place, cost = np.concatenate(parts), np.concatenate(costs)
    wide = np.flatnonzero(np.diff(place) > size)
    if len(wide):
        more = np.concatenate([np.arange(place[i] + size, place[i + 1], size) for i in wide])
        place, cost = np.concatenate((place, more)), np.concatenate((cost, np.full(len(more), CUT_ANYWHERE)))
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    return place.tolist(), cost.tolist()


def powers_of_two(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


Piece = tuple  # row, start, length, crc32, document's tokens, sequence, offset


def pack(stream: Iterator[tuple[object, bytes, np.ndarray]], size: int = SIZE, block: int = BLOCK) -> Iterator[Piece]:
    """Pieces of (row, ids, sentence ends), in order; sequences are numbered from 0."""
    held: list[list] = []  # row, ids, sentence ends, the document's tokens, tokens of it that are out
    total, sequence = 0, 0

    def emit(lengths: list[int]):
        nonlocal sequence, total
        at = 0
        for length in lengths:
            offset = 0
            while offset < length:
                row, ids, _, n, out = held[at]
                take = min(length - offset, n - out)
                yield row, out, take, zlib.crc32(memoryview(ids)[4 * out : 4 * (out + take)]), n, sequence, offset
                offset += take
                held[at][4] = out + take
                if out + take == n:
                    held[at][1] = b""
                    at += 1
            sequence += 1
            total -= length
        del held[:at]

    def solved(last: bool):
        where = cuts(*candidates([(n - out, ends - out) for _, _, ends, n, out in held], size), size)
        lengths = np.diff(where).tolist()
        if not last:
            return lengths[:-2] if len(lengths) > 2 else []
        if lengths and lengths[-1] < size:
            lengths[-1:] = powers_of_two(lengths[-1])
        return lengths

    for row, ids, ends in stream:
        n = len(ids) // 4
        held.append([row, ids, ends, n, 0])
        total += n
        if total >= block:
            yield from emit(solved(False))
    if held:
        yield from emit(solved(True))


RESULT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return text


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, text: str = "text", id_column: str = "doc_id", encoder: Callable[[str], object] = Words) -> DataFrame:
    """doc_id and the columns of RESULT, one row for each piece. tokenizer: path of a tokenizers JSON on the driver."""
    spark = docs.sparkSession
    ship(spark)
    spec = tokenizer_text(tokenizer)
    key = f"words-{zlib.crc32(spec.encode())}-{encoder.__name__}"
    held = spark.sparkContext.broadcast(spec)  # a vocabulary: its size does not follow the input
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = per_worker(key, lambda: encoder(held.value))

        def stream():
            for batch in small_batches(batches, 4 << 20):
                ids = batch.column(0).to_pylist()
                for i, (code, ends) in zip(ids, words.encode(batch.column(1).to_pylist())):
                    yield i, code, ends

        first = TaskContext.get().partitionId() << 32
        names = ["doc_id", *RESULT]
        rows: list[Piece] = []

        def out():
            columns = list(zip(*rows))
            columns[5] = [first + s for s in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for piece in pack(stream(), size):
            rows.append(piece)
            if len(rows) == 10_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return own.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *RESULT)))
