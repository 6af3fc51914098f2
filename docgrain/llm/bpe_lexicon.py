"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are compiled, with the ids that merging gives them, into a minimal acyclic automaton:
words share their beginnings and, as equal right languages are one state, their endings. Each arc carries the number of
words that come before it in its state; the sum along a word's path is its number, and its ids stand at that number in a
flat list. The whole is one file in the shared folder that workers map into memory. Words that it does not hold are merged
exactly, all that are new in a batch at once. A worker keeps what it has met lately, so the lexicon and the merger are asked for
most distinct words about once a worker. Texts are cut, looked up and written as Arrow and numpy arrays, distinct words once a batch.

Texts are split into words as the vocabulary's pre-tokenizer does, and
strings of special tokens are tokens, as the tokenizers library has it. Null and empty texts have no tokens. Repeated rows
and null ids are encoded like others. Text of any length is processed whole; merging an unseen word takes n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped_file, no_cycles, per_worker, put_file, saved, scratch, ship, small_batches

#: The pre-tokenizer's pattern, a fixed value of this vocabulary; \s is spelled out, as libraries differ on it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORDS = 50_000
SLOT_BITS = 19


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of these sizes that begin at these places, in a row."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def laid(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings in a row, where each begins in them, and how many it has."""
    kind = np.int64 if words.type in (pa.large_string(), pa.large_binary()) else np.int32
    at = np.frombuffer(words.buffers()[1] or b"", kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), at[:-1], np.diff(at)


class Vocabulary:
    """What a byte-level BPE tokenizers JSON says: ids of byte strings, ranks of merges, special tokens."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        letters = byte_letters()
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer is supported")
        self.id_of = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
        self.bytes_of = {i: word for word, i in self.id_of.items()}
        self.id_of_byte = [self.id_of[bytes((b,))] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges[self.id_of[a], self.id_of[b]] = (rank, self.id_of[a + b])
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = pairs[order], np.array([rank for rank, _ in self.merges.values()], np.int64)[order]
        self.merged_to = np.zeros(len(model["merges"]), np.int64)
        self.merged_to[self.pair_ranks] = np.array([to for _, to in self.merges.values()], np.int64)[order]
        # Each pair stands in the slot that its hash gives, unless another has it: then it is searched for in pair_keys.
        slot = self.slots_of(self.pair_keys)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        most = 1 + max(self.bytes_of, default=0)
        self.names = pa.array(map(str, range(most)), pa.large_string())
        self.raw = pa.array([self.bytes_of.get(i, b"") for i in range(most)], pa.large_binary())
        found = "|".join(regex.escape(x) for x in sorted(self.special, key=lambda x: (-len(x), x)))
        self.split = regex.compile(f"({found})") if found else None
        self.words = regex.compile(PATTERN)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of least rank, leftmost first, is joined until no pair has a rank."""
        ids = [*map(self.id_of_byte.__getitem__, word)]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        if n < 48:  # the ranks of all pairs in a list: quicker than a heap
            none = (len(merges), -1)
            get = merges.get
            found = [get(pair, none) for pair in zip(ids, ids[1:])]
            while found:
                best = min(found)
                if best is none:
                    break
                at = found.index(best)
                ids[at : at + 2] = [best[1]]
                del found[at]
                if at:
                    found[at - 1] = get((ids[at - 1], ids[at]), none)
                if at < len(found):
                    found[at] = get((ids[at], ids[at + 1]), none)
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue  # one of the two has been joined since
            ids[i], ids[j] = to, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (found := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, ids[x], ids[y], found[1]))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The same of each word."""
        flat, sizes = self.merged(*laid(pa.array(words, pa.large_binary())))
        ids, ends = flat.tolist(), np.cumsum(sizes).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def slots_of(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = self.slots_of(key)
        at = self.slots[slot]
        there = (at >= 0) & (self.pair_keys[at] == key)
        out = np.where(there, self.pair_ranks[at], len(self.merged_to))
        left = np.nonzero(self.crowded[slot] & ~there)
        if len(left[0]):
            at = np.minimum(np.searchsorted(self.pair_keys, key[left]), len(self.pair_keys) - 1)
            out[left] = np.where(self.pair_keys[at] == key[left], self.pair_ranks[at], len(self.merged_to))
        return out

    def merged(self, raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, which stand at these places of raw, in a row and how many each has. Words of a length go together: each round joins one pair of each, so that they stay of equal length."""
        none, letter = len(self.merged_to), np.array(self.id_of_byte, np.int64)
        order, found = np.argsort(lengths, kind="stable"), []  # of found: rows and their ids, a line each
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
            n = int(lengths[rows[0]])
            if len(rows) < 8 or n > 64 or n < 2 or not len(self.pair_keys):
                found += [(np.array([i]), np.array([self.merge(raw[begins[i] : begins[i] + n].tobytes())], np.int64).reshape(1, -1)) for i in rows.tolist()]
                continue
            row, ids = rows, letter[raw[begins[rows][:, None] + np.arange(n)]]
            ranks = self.ranks_of(ids[:, :-1], ids[:, 1:])
            while len(row):
                here = np.arange(len(row))
                best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
                rank = ranks[here, best] if ranks.shape[1] else np.full(len(row), none)
                over = rank == none
                if over.any():
                    found.append((row[over], ids[over]))
                    row, ids, ranks, best, rank = row[~over], ids[~over], ranks[~over], best[~over], rank[~over]
                    here = np.arange(len(row))
                    if not len(row):
                        break
                size = ids.shape[1]
                ids[here, best] = self.merged_to[rank]
                stays = np.ones(ids.shape, bool)
                stays[here, best + 1] = False
                ids = ids[stays].reshape(len(row), size - 1)
                ranks = ranks[stays[:, 1:]].reshape(len(row), size - 2)
                for place in (best - 1, best):  # the pairs on both sides of what was joined
                    inside = (place >= 0) & (place < size - 2)
                    at, place = here[inside], place[inside]
                    ranks[at, place] = self.ranks_of(ids[at, place], ids[at, place + 1])
        sizes = np.zeros(len(order), np.int64)
        for rows, ids in found:
            sizes[rows] = ids.shape[1]
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        for rows, ids in found:
            flat[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, sizes

    def pieces(self, text: str):
        """(words, id of the special token after them or None) in order."""
        if self.split is None or not any(s in text for s in self.special):
            yield self.words.findall(text), None
            return
        parts = self.split.split(text)
        for i in range(0, len(parts), 2):
            yield self.words.findall(parts[i]), self.special[parts[i + 1]] if i + 1 < len(parts) else None


MAGIC = b"DGLEX1\0\0"


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file of a minimal acyclic transducer of these distinct words and their ids."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        found = register.get(key)
        if found is None:
            found = register[key] = len(states)
            states.append(key)
        return found

    path: list[list] = [[False, []]]  # unfrozen states along the last word: [final, arcs]
    last = b""
    for word, _ in entries:
        common = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), common, -1):
            target = freeze(path.pop())
            path[-1][1].append((last[depth - 1], target))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        target = freeze(path.pop())
        path[-1][1].append((last[depth - 1], target))
    start = freeze(path[0])
    counts = []
    for final, arcs in states:  # targets are frozen before their sources
        counts.append(int(final) + sum(counts[t] for _, t in arcs))
    first, labels, targets, adds = [0], bytearray(), [], []
    for final, arcs in states:
        before = int(final)
        for byte, target in arcs:
            labels.append(byte)
            targets.append(target)
            adds.append(before)
            before += counts[target]
        first.append(len(labels))
    at = np.cumsum([0, *(len(ids) for _, ids in entries)])
    flat = [i for _, ids in entries for i in ids]
    blocks = [np.array(first, "<i4"), np.frombuffer(bytes(labels), np.uint8), np.array(targets, "<i4"), np.array(adds, "<i4"), np.array([f for f, _ in states], np.uint8), at.astype("<i4"), np.array(flat, "<i4")]
    out = bytearray(MAGIC + struct.pack("<q", start) + struct.pack(f"<{len(blocks)}q", *(b.nbytes for b in blocks)))
    for b in blocks:
        out += b.tobytes() + b"\0" * (-b.nbytes % 8)
    return bytes(out)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, held: mmap.mmap):
        self.map = held
        if self.map[:8] != MAGIC:
            raise ValueError("this is no lexicon")
        self.start = struct.unpack_from("<q", self.map, 8)[0]
        sizes = struct.unpack_from("<7q", self.map, 16)
        view, at, parts = memoryview(self.map), 72, []
        for size in sizes:
            parts.append((at, view[at : at + size]))
            at += size + -size % 8
        self.first, self.targets, self.adds, self.at, self.flat = (parts[i][1].cast("i") for i in (0, 2, 3, 5, 6))
        self.labels, self.final = parts[1][0], parts[4][1]
        self.met: dict[int, int] = {}
        # Arcs stand by state and, of one state, by byte: ascending, to be searched for many words at once.
        first, labels = np.frombuffer(self.first, np.int32), np.frombuffer(parts[1][1], np.uint8)
        self.arcs = np.repeat(np.arange(len(first) - 1, dtype=np.int64) << 8, np.diff(first)) | labels

    def __len__(self) -> int:
        return len(self.at) - 1

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None. Arcs are kept as they are met, those that are not there as well."""
        state, number, met = self.start, 0, self.met
        for byte in word:
            at = state << 8 | byte
            arc = met.get(at)
            if arc is None:
                arc = met[at] = self.arc(state, byte)
            if arc < 0:
                return None
            number += self.adds[arc]
            state = self.targets[arc]
        if not self.final[state]:
            return None
        return self.flat[self.at[number] : self.at[number + 1]].tolist()

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        """The same of each word."""
        return [self.flat[self.at[n] : self.at[n + 1]].tolist() if n >= 0 else None for n in self.numbers(*laid(pa.array(words, pa.large_binary()))).tolist()]

    def numbers(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word, which stand at these places of raw, or -1; all go one byte further at a time, until they end or have no arc."""
        out = np.full(len(sizes), -1, np.int64)
        if not len(self.arcs):  # no word, or the empty one only
            out[sizes == 0] = len(self) - 1
            return out
        targets, adds, final = (np.frombuffer(x, kind) for x, kind in ((self.targets, np.int32), (self.adds, np.int32), (self.final, np.uint8)))
        row, state, number, at = np.arange(len(sizes)), np.full(len(sizes), self.start, np.int64), np.zeros(len(sizes), np.int64), 0
        while len(row):
            ended = sizes[row] == at
            there = ended & (final[state] > 0)
            out[row[there]] = number[there]
            row, state, number = row[~ended], state[~ended], number[~ended]
            key = state << 8 | raw[begins[row] + at]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            there = self.arcs[arc] == key
            row, number, arc, at = row[there], number[there], arc[there], at + 1
            number, state = number + adds[arc], targets[arc].astype(np.int64)
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of these numbers in a row, and how many each has."""
        at = np.frombuffer(self.at, np.int32).astype(np.int64)
        sizes = at[numbers + 1] - at[numbers]
        return gathered(np.frombuffer(self.flat, np.int32), at[numbers], sizes), sizes

    def arc(self, state: int, byte: int) -> int:
        """The arc from a state by a byte, or -1."""
        if len(self.met) > 1_000_000:
            self.met.clear()
        return max(-1, self.map.find(bytes((byte,)), self.labels + self.first[state], self.labels + self.first[state + 1]) - self.labels)


#: Counts below are told apart each, those above by 64 bins an octave.
EXACT_COUNTS = 1024


def frequent_words(docs: DataFrame, vocabulary_json: str, words: int = WORDS, text: str = "text") -> list[str]:
    """The words of the pre-tokenizer that stand most often in all texts, words of them at most.

    What stands between spaces is counted in all texts. A histogram of the counts (some thousand rows) gives the least count that
    no more than this many have; what has it goes to the driver and is cut to words here. What stands once is no frequent word.
    """
    spark = docs.sparkSession
    ship(spark)

    def count(batches):
        held, size = [], 0

        def out():
            counts = pc.value_counts(pc.list_flatten(pc.split_pattern(pa.chunked_array(held), " ")))
            return pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["chunk", "n"])

        for batch in small_batches(batches, 16 << 20):
            held.append(batch.column(0))
            size += batch.nbytes
            if size > 8 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    rows = docs.select(F.col(text).alias("text")).where("text is not null and text <> ''").mapInArrow(count, "chunk string, n long")
    total = rows.where("chunk <> '' and length(chunk) < 64").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    bin_of = F.when(F.col("n") < EXACT_COUNTS, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + F.lit(EXACT_COUNTS - 640))
    held = saved(total.withColumn("bin", bin_of.cast("long")), "word-counts")
    least, room = None, words
    for r in held.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")).collect():
        room -= r["k"]
        if room < 0:
            break
        least = r["bin"]
    vocabulary, found = Vocabulary(vocabulary_json), Counter()
    for r in held.where(F.col("bin") >= least).select("chunk", "n").collect() if least is not None else ():
        for parts, _ in vocabulary.pieces(" " + r["chunk"]):
            for w in parts:
                found[w] += r["n"]
    return sorted(sorted(found), key=lambda w: -found[w])[:words]


def lexicon_file(docs: DataFrame, vocabulary_json: str, words: int = WORDS, text: str = "text") -> str:
    """Path in the shared folder of the lexicon of the frequent words of these texts."""
    vocabulary = Vocabulary(vocabulary_json)
    found = [x.encode("utf-8", "surrogatepass") for x in frequent_words(docs, vocabulary_json, words, text)]
    path = scratch(docs.sparkSession, "lexicon")
    put_file(path, compile_lexicon(list(zip(found, vocabulary.merge_many(found)))))
    return path


class Met:
    """Ids of texts met lately; what falls out of one generation is kept for one more. The ids of a generation stand in one array."""

    def __init__(self, most: int):
        self.most, self.now, self.then = most, {}, {}
        self.ids, self.ids_then, self.used = np.empty(1 << 12, np.int32), np.empty(0, np.int32), 0

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys in a row and how many each has: -1 if the key is unknown."""
        at = np.fromiter(map(self.now.get, keys, repeat(-1)), np.int64, len(keys))
        flat, lacks = self.ids[: self.used], np.flatnonzero(at < 0)
        if not len(lacks) or not self.then:
            sizes = np.where(at < 0, 0, at & 255)
            return gathered(flat, at >> 8, sizes), np.where(at < 0, -1, sizes)
        old = [keys[i] for i in lacks.tolist()]
        at_then = np.fromiter(map(self.then.get, old, repeat(-1)), np.int64, len(old))
        known = np.flatnonzero(at_then >= 0)
        at[lacks[known]] = at_then[known] + (self.used << 8)
        sizes = np.where(at < 0, 0, at & 255)
        out = gathered(np.concatenate([flat, self.ids_then]), at >> 8, sizes), np.where(at < 0, -1, sizes)
        kept = at_then[known]
        self.put([old[i] for i in known.tolist()], gathered(self.ids_then, kept >> 8, kept & 255), kept & 255)
        return out

    def put(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps the ids of keys, 255 each at most."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        for a in range(0, len(keys), self.most):
            b = min(a + self.most, len(keys))
            if len(self.now) + b - a > self.most:
                self.then, self.ids_then = self.now, self.ids[: self.used].copy()
                self.now, self.used = {}, 0
            more = flat[begins[a] : ends[b - 1]]
            need = self.used + len(more)
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.empty(need + need // 4 - self.used, np.int32)])
            self.ids[self.used : need] = more
            self.now.update(zip(keys[a:b], ((self.used + begins[a:b] - begins[a]) << 8 | sizes[a:b]).tolist()))
            self.used = need


def unspaced(chunk: str) -> bool:
    """Whether spaces on both sides of it cut a text at words' ends."""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


def doubtful(chunks: pa.Array) -> np.ndarray:
    """Of which chunks the first or last byte leaves open whether they are unspaced: control characters, spaces, bytes of others beyond ASCII, or none."""
    raw, begins, sizes = laid(chunks)
    out = sizes == 0
    there = np.flatnonzero(~out)
    first, last = raw[begins[there]], raw[begins[there] + sizes[there] - 1]
    out[there] = (first <= 32) | (last <= 32) | (last >= 128) | np.isin(first, (0xC2, 0xE1, 0xE2, 0xE3))
    return out


class Encoder:
    """Encodes texts, many at once; what was met before is looked up, the rest taken from the lexicon or merged.

    A space between two characters that are no white space always begins a word, and no word goes across it. So texts are
    cut at spaces, and what stands between two is looked up as a whole, each distinct one once. Only what is new is cut by the
    pattern. Texts with other white space beside a space, or with a special token, are cut by the pattern as a whole, and their
    distinct words are not kept but asked for with each batch. Ids of all that was looked up stand in one array, from which those of the
    texts are gathered.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, most: int = 340_000):
        self.met = Met(most)
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.from_lexicon = self.merged = 0

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row and how many each has: from the lexicon or, of those that it lacks, by merging all at once."""
        raw, begins, lengths = laid(words)
        numbers = self.lexicon.numbers(raw, begins, lengths) if self.lexicon is not None else np.full(len(words), -1, np.int64)
        has, lacks = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        flat, sizes = self.vocabulary.merged(raw, begins[lacks], lengths[lacks])
        self.from_lexicon += len(has)
        self.merged += len(lacks)
        if not len(has):
            return flat, sizes
        more, more_sizes = self.lexicon.ids(numbers[has])
        order = np.empty(len(words), np.int64)
        order[np.concatenate([lacks, has])] = np.arange(len(words))
        sizes = np.concatenate([sizes, more_sizes])
        starts = np.cumsum(sizes) - sizes
        return gathered(np.concatenate([flat, more]), starts[order], sizes[order]), sizes[order]

    def made(self, chunks: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of what is unknown, in a row, and how many each has: of chunks that stand behind a space, and of other texts as they are."""
        findall = self.vocabulary.words.findall
        words = findall(" " + " ".join(chunks)) if chunks else []
        count, more = len(words), []
        for x in others:
            more.append(len(words))
            words += findall(x)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        which = coded.indices.to_numpy()
        raw, begins, _ = laid(coded.dictionary)
        flat, sizes = self.look_up(coded.dictionary)
        # No word has a space in it but before it, and each chunk begins with such a word.
        first = np.concatenate([np.flatnonzero(raw[begins][which[:count]] == 32), more]).astype(np.int64)
        starts, sizes_of = np.cumsum(sizes) - sizes, sizes[which]
        return gathered(flat, starts[which], sizes_of), np.add.reduceat(sizes_of, first) if words else np.zeros(0, np.int64)

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. No text is null."""
        vocabulary = self.vocabulary
        whole = np.zeros(len(texts), bool)  # to be cut by the pattern as a whole
        for s in vocabulary.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~whole)
        lists = pc.split_pattern(texts.take(pa.array(rows)) if whole.any() else texts, " ")
        coded, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        kinds = len(coded.dictionary)
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, kinds], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ") if kinds else []
        flat, sizes = self.met.find(chunks)
        new = np.flatnonzero(sizes < 0)
        bad = np.array([i for i in new[doubtful(coded.dictionary)[new]].tolist() if not unspaced(chunks[i])], np.int64)
        cuts = np.ones(kinds + 1, bool)
        cuts[bad] = False
        # What a text begins with has no space before it.
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[bounds[:-1]] = kinds
        begins_with = pc.list_element(lists, 0).to_pylist()
        fits = np.logical_and.reduceat(cuts[codes], bounds[:-1]) if len(rows) else np.zeros(0, bool)
        fits &= np.fromiter((bool(x) and not x[-1].isspace() for x in begins_with), bool, len(rows))
        whole[rows[~fits]] = True
        others: dict[str, int] = {}  # texts besides the chunks, numbered after them
        number = others.setdefault
        codes[bounds[:-1]] = [number(x, kinds + len(others)) if fit else kinds for x, fit in zip(begins_with, fits.tolist())]
        codes = codes[np.repeat(fits, np.diff(bounds))]
        counts = np.zeros(len(texts), np.int64)
        counts[rows[fits]] = np.diff(bounds)[fits]
        more = []
        for i in np.flatnonzero(whole).tolist():
            before = len(more)
            for words, special in vocabulary.pieces(texts[i].as_py()):
                more += [number(w, kinds + len(others)) for w in words]
                if special is not None:
                    more.append(-1 - special)
            counts[i] = len(more) - before
        if more:
            order = np.argsort(whole[np.repeat(np.arange(len(texts)), counts)], kind="stable")
            apart = np.concatenate([codes, more])
            codes = np.empty(len(order), np.int64)
            codes[order] = apart
        # Special tokens are one id each, behind all others.
        lone = np.flatnonzero(codes < 0)
        specials, at = np.unique(-1 - codes[lone], return_inverse=True)
        codes[lone] = kinds + len(others) + at
        new = new[cuts[new]]
        names = [chunks[i] for i in new.tolist()]
        new_flat, new_sizes = self.made(names, [*others])
        new_begins = np.cumsum(new_sizes) - new_sizes
        short = np.flatnonzero(np.fromiter(map(len, names), np.int64, len(names)) < 64)
        self.met.put([names[i] for i in short.tolist()], gathered(new_flat, new_begins[short], new_sizes[short]), new_sizes[short])
        known = np.maximum(sizes, 0)
        begins = np.cumsum(known) - known
        begins[new], sizes[new] = len(flat) + new_begins[: len(new)], new_sizes[: len(new)]
        pool = np.concatenate([flat, new_flat, specials.astype(np.int32)])
        begins = np.concatenate([begins, len(flat) + new_begins[len(new) :], len(flat) + len(new_flat) + np.arange(len(specials))])
        sizes = np.concatenate([sizes, new_sizes[len(new) :], np.ones(len(specials), np.int64)])
        of_codes = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(of_codes)])
        to = np.cumsum(counts)
        return gathered(pool, begins[codes], of_codes), ends[to] - ends[to - counts]

    def written(self, flat: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
        """Of each text the ids in decimal, joined by commas, and the bytes that they decode to."""
        bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
        out = []
        for each, between in ((self.vocabulary.names, ","), (self.vocabulary.raw, b"")):
            done = pc.binary_join(pa.LargeListArray.from_arrays(bounds, each.take(pa.array(flat))), pa.scalar(between, each.type))
            at, data = np.frombuffer(done.buffers()[1] or b"", np.int64)[: len(done) + 1].tolist(), memoryview(done.buffers()[2] or b"")
            out.append([data[a:b] for a, b in zip(at, at[1:])])
        return out[0], out[1]

    def batch(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """Of each text its ids in decimal, joined by commas, with what they decode to; nothing if there are none."""
        ids, raw = self.written(*self.ids_of(pa.array(texts, pa.string())))
        return [[(str(i, "ascii"), bytes(r))] if len(i) else [] for i, r in zip(ids, raw)]

    def encode(self, text: str) -> list[int]:
        return self.ids_of(pa.array([text], pa.string()))[0].tolist()


def decoded(raw) -> str:
    """The text of the bytes of all tokens in a row: read as UTF-8, with U+FFFD for what is none."""
    return str(raw, "utf-8", "replace")


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    return decoded(b"".join([vocabulary.bytes_of[i] for i in ids]))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, tokenizer: str, words: int = WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of what they decode to; with ids, the ids too. tokenizer: path of a tokenizers JSON on the driver."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    path = lexicon_file(docs, spec, words)
    held = spark.sparkContext.broadcast(spec)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        def fresh():
            vocabulary = Vocabulary(held.value)
            return Encoder(vocabulary, Lexicon(mapped_file(path)))

        encoder = per_worker(path, fresh)
        for batch in small_batches(batches, 4 << 20):
            with no_cycles():
                flat, counts = encoder.ids_of(batch.column(1))
                ids, raw = encoder.written(flat, counts)
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decoded(x).encode("utf-8", "surrogatepass")).hexdigest() for x in raw], pa.string()),
            ]
            names = [f.split()[0] for f in RESULT.split(", ")]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(run, RESULT + ", ids array<int>" * with_ids)
