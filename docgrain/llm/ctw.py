"""Language-model scoring by context-tree weighting over bytes.

A text is scored as its lower-cased (A-Z) words, joined by one space and ended by \\n. Every byte is coded as eight binary
decisions, each in the contexts of the 0 to DEPTH bytes before it. At each context and decision a Krichevsky-Trofimov
estimate stands for the counts of zeros and ones that the training texts gave; contexts of all depths are mixed by the
weights of context-tree weighting: half to a node's own estimate, half to the product of its children, on all its
training data. The mixture, fixed after training, gives the probability of each byte, and so code lengths per byte.

Counts cover all training texts, and every context counted is in the tree, which grows with the input. The tree is cut by
the last UPPER bytes of contexts into shards: a task gets the counts of its contexts and the grams of held-out texts
after them, builds the nodes of depth UPPER and deeper, and writes the mixture so far of each of its grams. What lies above is
small for any input (byte triples): the driver builds it from sums over the shards, and further tasks finish the grams.
So the model is a table of log probabilities of all grams that any text has, one file a shard in the shared folder, which
scoring tasks map shard by shard.

The unigram base score counts words by a 64-bit hash. The counts of the TOP words are sent to executors, those of all others
are met by a join.

Null text is the empty text, of one token. A null doc_id counts as the text ''. Repeated rows are scored, and counted, each.
An empty training set gives every decision one half.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import opened, id_crc, per_worker, saved, scratch, ship, shuffle_width, small_batches

DEPTH, UPPER, TOP = 6, 3, 150_000
#: Grams of which a task builds nodes at a time, besides those of the last context of UPPER bytes; cuts none.
MOST_PAIRS = 100_000
#: Bytes of text that a worker takes at a time; arrays made on the way take some fifty times as much.
BATCH = 1 << 20
END = b"\n"
LN10 = math.log(10)
FOLDS, HELD = 5, 1


def words_of(text: str) -> list[bytes]:
    """Of bytes: lower() changes A-Z only and split() knows 9 to 13 and 32 only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_key(word: bytes) -> int:
    x = xxhash.xxh64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


#: The end token's key; words are hashed without white space, so no word is this text.
END_KEY = word_key(END)


def gram_keys(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For each byte of these texts, each ended by END: the depth bytes before it, last first, then the byte, as one number.

    Before a text stand END bytes.
    """
    raw = np.frombuffer(END * depth + b"".join(t + END * depth for t in texts), np.uint8)
    keys = np.zeros(len(raw) - depth, np.uint64)
    for d in range(1, depth + 1):
        keys |= raw[depth - d : len(raw) - d].astype(np.uint64) << np.uint64(8 * (depth - d + 1))
    keys |= raw[depth:].astype(np.uint64)
    # Of the END bytes after a text only the first is coded.
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + depth)))[:-1]
    coded = np.ones(len(keys), bool)
    for k in range(1, depth):
        coded[first + sizes + k] = False
    return keys[coded]


class Slots:
    """A direct-mapped table of 64-bit keys: a key has one slot, which holds one key."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        return slot, self.keys[slot] == keys


class GramCounter:
    """Counts keys in a table of fixed size; those whose slot is taken by another are gathered beside it."""

    def __init__(self, bits: int = 22, most_beside: int = 1 << 20):
        self.slots, self.counts = Slots(bits), np.zeros(1 << bits, np.int64)
        self.beside: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, most_beside

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Counts; gives (keys, counts) to be summed elsewhere when too many are beside the table."""
        slot, hit = self.slots.find(keys)
        self.counts += np.bincount(slot[hit], minlength=len(self.counts))
        new, n = np.unique(keys[~hit], return_counts=True)
        slot, _ = self.slots.find(new)
        own = self.slots.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
        first = np.zeros(len(new), bool)
        first[np.unique(slot, return_index=True)[1]] = True
        own &= first
        self.slots.keys[slot[own]] = new[own]
        self.counts[slot[own]] += n[own]
        self.beside.append((new[~own], n[~own]))
        self.waiting += int((~own).sum())
        if self.waiting <= self.most:
            return None
        keys, counts = self.merged()
        if len(keys) > self.most // 2:
            self.beside, self.waiting = [], 0
            return keys, counts
        self.beside, self.waiting = [(keys, counts)], len(keys)
        return None

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in self.beside]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in self.beside]), len(keys)).astype(np.int64)

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.counts)
        keys, counts = self.merged() if self.beside else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return np.concatenate((self.slots.keys[at], keys)), np.concatenate((self.counts[at], counts))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series after a shift of eight."""
    y = x + 8.0
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Tree:
    """The weighted tree, fixed: for each depth d the sorted contexts of d bytes and their first nodes; of each node the nodes
    after a zero and a one, the probabilities of a zero and of a one, the same that stand for contexts not kept, and the weight of its own.

    Both probabilities are held, as the lesser of the two is lost in the rounding of the greater.
    """

    PARTS = ("contexts", "roots", "child", "probs")

    def __init__(self, depth: int, top: int, contexts, roots, child, probs):
        self.depth, self.top, self.contexts, self.roots, self.child, self.probs = depth, top, contexts, roots, child, probs

    @staticmethod
    def built(depth: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        """pairs: for each depth d the (context of d bytes, byte) pairs as numbers, and their counts. A kept context's shorter ones must be kept."""
        return Tree.part(depth, pairs)[0]

    @staticmethod
    def part(depth: int, pairs: list, top: int = 0, inner: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Tree, tuple[np.ndarray, np.ndarray]]:
        """The depths from top to depth, and what the part above needs as inner: its nodes that have children here, and the sums of these
        children's logs of weighted probabilities."""
        contexts, roots, child, probs = ([None] * (depth + 1) for _ in range(4))
        below = None  # of the depth under this one: node keys, counts of zeros and ones, log of the weighted probability
        for d in range(depth, top - 1, -1):
            grams, counts = pairs[d]
            context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
            node = np.concatenate([(context << np.uint64(8)) | ((256 | byte) >> (8 - k)).astype(np.uint64) for k in range(8)])
            bit = np.concatenate([byte >> (7 - k) & 1 for k in range(8)])
            keys, at = np.unique(node, return_inverse=True)
            count = np.tile(counts.astype(np.float64), 8)
            n1 = np.bincount(at, count * bit, len(keys))
            n0 = np.bincount(at, count, len(keys)) - n1
            del node, bit, at, count
            pe = log_kt(n0, n1)
            if below is None and inner is not None and len(inner[0]):
                parent = np.searchsorted(keys, inner[0])
                inside, has = np.zeros(len(pe)), np.zeros(len(pe), bool)
                inside[parent], has[parent] = inner[1], True
                log_w = np.where(has, np.logaddexp(pe, inside) - math.log(2), pe)
                own, rest0, rest1 = np.where(has, np.exp(pe - math.log(2) - log_w), 1.0), n0, n1
            elif below is None or not len(below[0]):
                log_w, own, rest0, rest1 = pe, np.ones(len(pe)), np.zeros(len(pe)), np.zeros(len(pe))
            else:
                # A node's parent has the last byte of its context dropped and the same decision.
                lower, low0, low1, low_w = below
                parent = np.searchsorted(keys, ((lower >> np.uint64(16)) << np.uint64(8)) | (lower & np.uint64(255)))
                r0 = np.maximum(0, n0 - np.bincount(parent, low0, len(pe)))
                r1 = np.maximum(0, n1 - np.bincount(parent, low1, len(pe)))
                some = r0 + r1 > 0
                inside = np.bincount(parent, low_w, len(pe)) + np.where(some, log_kt(r0, r1), 0.0)
                has = np.bincount(parent, minlength=len(pe)) > 0
                log_w = np.where(has, np.logaddexp(pe, inside) - math.log(2), pe)
                own = np.where(has, np.exp(pe - math.log(2) - log_w), 1.0)
                rest0, rest1 = np.where(some, r0, n0), np.where(some, r1, n1)
            below = (keys, n0, n1, log_w)
            probs[d] = np.stack([*((x + 0.5) / (a + b + 1) for a, b in ((n0, n1), (rest0, rest1)) for x in (a, b)), own], axis=1).astype(np.float32)
            root = np.flatnonzero((keys & np.uint64(255)) == 1)
            contexts[d], roots[d] = keys[root] >> np.uint64(8), root.astype(np.int32)
            child[d] = np.full((len(keys), 2), -1, np.int32)
            if len(keys):
                for one in (0, 1):
                    inner = np.flatnonzero((keys & np.uint64(255)) < 128)
                    key = (keys[inner] & ~np.uint64(255)) | ((keys[inner] & np.uint64(255)) * np.uint64(2) + np.uint64(one))
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    child[d][inner, one] = np.where(keys[at] == key, at, -1)
        parents, at = np.unique(((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)
        return Tree(depth, top, contexts, roots, child, probs), (parents, np.bincount(at, log_w, len(parents)))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, part)[d] for part in self.PARTS for d in range(self.depth + 1)]

    @staticmethod
    def of(depth: int, arrays) -> Tree:
        n = depth + 1
        return Tree(depth, 0, *(arrays[i * n : (i + 1) * n] for i in range(4)))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context; quickest on sorted grams."""
        return log10_of(self.mixed(grams, self.depth))

    def mixed(self, grams: np.ndarray, whole: int, deeper: np.ndarray | None = None) -> np.ndarray:
        """(grams, 8): the probability of each decision on the way to a gram's byte, mixed over the contexts of this part, NaN where it
        has none. The grams have whole context bytes. deeper: the same of the part below."""
        byte = (grams & np.uint64(255)).astype(np.int64)
        rows, nodes = [], []
        known, out = np.arange(len(grams)), np.full((len(grams), 8), np.nan, np.float32)
        for d in range(self.top, self.depth + 1):
            held = self.contexts[d]
            context = grams[known] >> np.uint64(8 * (whole - d + 1)) if d else np.zeros(len(known), np.uint64)
            at = np.minimum(np.searchsorted(held, context), len(held) - 1) if len(held) else np.zeros(len(known), np.int64)
            there = held[at] == context if len(held) else np.zeros(len(known), bool)
            known = known[there]
            rows.append(known)
            nodes.append(self.roots[d][at[there]])
        for k in range(8):
            bit = byte >> (7 - k) & 1
            p = np.full(len(grams), np.nan, np.float32) if deeper is None else deeper[:, k].copy()
            inside = ~np.isnan(p)
            for d in range(self.depth - self.top, -1, -1):
                r, node = rows[d], nodes[d]
                if not len(r):
                    continue
                held, taken = self.probs[d + self.top][node], bit[r]
                own = held[:, 4]
                p[r] = own * np.where(taken, held[:, 1], held[:, 0]) + (1 - own) * np.where(inside[r], p[r], np.where(taken, held[:, 3], held[:, 2]))
                inside[r] = True
                after = self.child[d + self.top][node, taken]
                alive = after >= 0
                rows[d], nodes[d] = r[alive], after[alive]
            out[:, k] = p
        return out


def log10_of(mixed: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's byte, from those of its decisions; one half where no context is known."""
    return np.log10(np.where(np.isnan(mixed), 0.5, mixed.astype(np.float64))).sum(axis=1)


def shard_of(grams: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """By the last UPPER bytes of the context, so that a shard has all that is deeper."""
    upper = min(UPPER, depth)
    context = grams >> np.uint64(8 * (depth - upper + 1)) if upper else np.zeros(len(grams), np.uint64)
    return ((context * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


class Scorer:
    """log10 probabilities of grams, from the tables of their shards; grams met lately are kept in a table of fixed size."""

    def __init__(self, depth: int, folder: str, shards: int, bits: int = 21):
        self.depth, self.folder, self.shards = depth, folder, shards
        self.slots, self.values = Slots(bits), np.zeros(1 << bits, np.float64)

    def fresh(self, grams: np.ndarray) -> np.ndarray:
        """Of distinct, ascending grams, all of which some table has."""
        out, shard = np.zeros(len(grams)), shard_of(grams, self.depth, self.shards)
        order = np.argsort(shard, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            keys, logs = mapped(f"{self.folder}/{shard[at[0]]}.logs")
            out[at] = logs[np.searchsorted(keys, grams[at])]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot, hit = self.slots.find(keys)
        out = self.values[slot]
        if not hit.all():
            new, back = np.unique(keys[~hit], return_inverse=True)
            value = self.fresh(new)
            out[~hit] = value[back]
            slot, _ = self.slots.find(new)
            # Of several new keys of one slot the last stays, in both tables.
            self.slots.keys[slot] = new
            self.values[slot] = value
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        value = self(gram_keys(texts, self.depth))
        ends = np.cumsum([len(t) + 1 for t in texts])
        sums = np.concatenate(([0.0], np.cumsum(value)))
        return sums[ends] - sums[ends - [len(t) + 1 for t in texts]]


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


#: Keys in one row of what counting tasks hand on.
PACKET = 4096


def counted(docs: DataFrame, depth: int, folder: str, buckets: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(kind, key, n, x), written to the shared folder: kind 0 words by hash, 1 the pairs of the depth above the shards, 2 its nodes and sums of
    their children's x, 3 the shards that have grams; words and pairs over all rows that are not held out.

    Tasks hand on what they have summed in packets of sorted keys, grams dealt by shard and words by a hash; those that a bucket
    gets are merged as arrays, as they come, so that a task holds the distinct keys of its bucket. The mixture of a shard's grams,
    those of held-out texts too, goes to a file in the folder.
    """
    spark = docs.sparkSession
    ship(spark)
    upper = min(UPPER, depth)

    def packets(kind: int, keys: np.ndarray, counts: np.ndarray):
        keys, counts = np.asarray(keys).astype(np.uint64), np.asarray(counts, np.int64)
        bucket = shard_of(keys, depth, buckets) if kind else ((keys * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)])).tolist() if len(keys) else []
        spans = [(i, min(i + PACKET, b)) for a, b in zip(edges, edges[1:]) for i in range(a, b, PACKET)]
        for at in range(0, len(spans), 64):
            part = spans[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in part], pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array([keys[a:b].tobytes() for a, b in part], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in part], pa.binary())], names=["bucket", "kind", "keys", "counts"])

    def word_packets(words):
        yield from packets(0, np.array([word_key(w) for w in words], np.int64), np.fromiter(words.values(), np.int64, len(words)))

    def run(batches):
        counters, words = {1: GramCounter(), 2: GramCounter(20)}, Counter()
        for batch in small_batches(batches, 2 * BATCH):
            split = {1: [], 2: []}
            for t, is_held in zip(*(c.to_pylist() for c in batch.columns)):
                split[2 if is_held else 1].append(words_of(t))
            for s in split[1]:
                words.update(s)
            if split[1]:
                words[END] += len(split[1])
            for kind, grams in counters.items():
                if split[kind] and (over := grams.add(gram_keys([b" ".join(s) for s in split[kind]], depth))) is not None:
                    yield from packets(kind, *over)
            if len(words) > 250_000:
                yield from word_packets(words)
                words.clear()
        yield from word_packets(words)
        for kind, grams in counters.items():
            yield from packets(kind, *grams.rest())

    def merge(batches):
        now, parts, waiting = None, [], 0

        def rows(kind, keys, n=None, x=None):
            n, x = np.zeros(len(keys), np.int64) if n is None else n, np.zeros(len(keys)) if x is None else x
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(n[part]), pa.array(x[part])], names=["kind", "key", "n", "x"])

        def out():
            keys, counts = merged_counts(parts)
            if not now[1]:
                yield from rows(0, keys, counts)
                return
            mixed = []
            for a, b in spans_of(keys, depth, most_pairs):
                of_train = counts[a:b] > 0
                train, n = keys[a:b][of_train], counts[a:b][of_train]
                pairs = [shorter(train, n, depth, d) if d >= upper else None for d in range(depth + 1)]
                tree, (parents, sums) = Tree.part(depth, pairs, upper)
                mixed.append(tree.mixed(keys[a:b], depth))
                if upper:
                    yield from rows(1, *shorter(train, n, depth, upper - 1))
                    yield from rows(2, parents, x=sums)
            write_arrays(f"{folder}/{now[0]}.mixed", [keys, np.concatenate(mixed)])
            yield from rows(3, np.array([now[0]], np.uint64))

        for batch in batches:
            for bucket, kind, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, kind > 0) != now:
                    if parts:
                        yield from out()
                    now, parts, waiting = (bucket, kind > 0), [], 0
                # What held-out texts have is scored, and does not count.
                counts = np.frombuffer(counts, np.int64)
                parts.append((np.frombuffer(keys, np.uint64), counts * 0 if kind == 2 else counts))
                waiting += len(keys) // 8
                if waiting > 1 << 21:
                    parts = [merged_counts(parts)]
                    waiting = len(parts[0][0]) // 2  # what stays grows, so merges stay rare
        if parts:
            yield from out()

    found = docs.select("text", "held_out").mapInArrow(run, "bucket int, kind int, keys binary, counts binary")
    dealt = found.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    return saved(dealt.mapInArrow(merge, "kind int, key long, n long, x double"), "ctw-counts")


def spans_of(keys: np.ndarray, depth: int, most: int) -> list[tuple[int, int]]:
    """Ranges of sorted grams that share no context of UPPER bytes, of about most grams; one at least."""
    upper = min(UPPER, depth)
    context = keys >> np.uint64(8 * (depth - upper + 1)) if upper else np.zeros(len(keys), np.uint64)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    cuts = [0]
    for a in first[np.searchsorted(first, np.arange(most, len(keys), most), "left").clip(max=len(first) - 1)].tolist():
        if a > cuts[-1]:
            cuts.append(a)
    return list(zip(cuts, [*cuts[1:], len(keys)]))


def shorter(grams: np.ndarray, counts: np.ndarray, depth: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context of d bytes, byte) pairs of grams, and their counts."""
    context = (grams >> np.uint64(8 * (depth - d + 1))) << np.uint64(8) if d else np.uint64(0)
    return merged_counts([(context | (grams & np.uint64(255)), counts)])


def trained(counts: DataFrame, depth: int, folder: str) -> None:
    """Finishes the tables of all shards in the folder: their grams, sorted, and the log10 of their probabilities."""
    spark = counts.sparkSession
    upper = min(UPPER, depth)
    held = None
    if upper:
        got = counts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        key, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        # Summed in ascending order, so that runs agree; a node has at most 256 children.
        total = F.aggregate(F.sort_array(F.collect_list("x")), F.lit(0.0), lambda a, x: a + x)
        got = counts.where("kind = 2").groupBy("key").agg(total.alias("x")).toArrow()
        parents, sums = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
        order = np.argsort(parents)
        tree, _ = Tree.part(upper - 1, [shorter(key, n, upper - 1, d) for d in range(upper)], 0, (parents[order], sums[order]))
        held = f"{folder}/upper"
        write_arrays(held, tree.arrays())

    def run(batches):
        tree = Tree.of(upper - 1, mapped(held)) if held else None
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                keys, mixed = mapped(f"{folder}/{shard}.mixed")
                logs = [np.zeros(0)]
                for i in range(0, len(keys), 100_000):
                    some, deeper = keys[i : i + 100_000], mixed[i : i + 100_000]
                    logs.append(log10_of(tree.mixed(some, depth, deeper) if tree else deeper))
                write_arrays(f"{folder}/{shard}.logs", [keys, np.concatenate(logs).astype(np.float32)])
                yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["n"])

    some = {r["key"] for r in counts.where("kind = 3").select("key").collect()}
    if some:  # one task a shard
        spark.range(0, max(some) + 1, 1, max(some) + 1).where(F.col("id").isin(some)).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """These arrays as one file of the shared folder."""
    spec = json.dumps([[a.dtype.str, a.shape] for a in arrays]).encode()
    system, inside = opened(path)
    system.create_dir(os.path.dirname(inside), recursive=True)
    with system.open_output_stream(inside) as f:
        f.write(len(spec).to_bytes(8, "little") + spec + b" " * (-len(spec) % 8))
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))


def mapped(path: str) -> list[np.ndarray]:
    """The arrays of write_arrays, mapped into memory: one copy for all workers of a machine. From a store that is no file system, a copy without a name is mapped."""
    system, inside = opened(path)
    if system.type_name == "local":
        whole = np.memmap(inside, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as own, system.open_input_stream(inside) as f:
            shutil.copyfileobj(f, own, 1 << 20)
            own.flush()
            whole = np.memmap(own, np.uint8, "r")
    n = int.from_bytes(whole[:8].tobytes(), "little")
    spec = json.loads(whole[8 : 8 + n].tobytes())
    at, out = 8 + n + -n % 8, []
    for kind, shape in spec:
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out.append(whole[at : at + size].view(kind).reshape(shape) if size else np.zeros(shape, kind))
        at += size + -size % 8
    return out


def scores(docs: DataFrame, depth: int = DEPTH, most_pairs: int = MOST_PAIRS, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every document."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (id_crc(F.col("doc_id")) % FOLDS == HELD).alias("held_out"))
    model, shards = scratch(spark, "ctw-model"), shuffle_width(spark)
    counts = counted(docs, depth, model, shards, most_pairs)
    trained(counts, depth, model)
    words = counts.where("kind = 0").select("key", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("key") == END_KEY, F.col("n"))), F.lit(0)).alias("ends")).first()
    tokens, distinct, ends = sums["n"], sums["v"], sums["ends"]
    most = words.orderBy(F.desc("n"), "key").limit(top).toArrow()
    held = spark.sparkContext.broadcast(dict(zip(most.column(0).to_pylist(), most.column(1).to_pylist())))
    whole = len(held.value) == distinct  # then a word that it lacks has no count

    def run(batches):
        known = held.value
        scorer = per_worker(model, lambda: Scorer(depth, model, shards))
        end_term, unknown = math.log10(ends + 0.5), math.log10(0.5)
        terms = {c: math.log10(c + 0.5) for c in set(known.values())}

        class Places(dict):
            """Numbers of the words met; a new one gets the next."""

            def __missing__(self, word: bytes) -> int:
                n = self[word] = len(self)
                self.new.append(word)
                return n

        places = Places()
        for batch in small_batches(batches, BATCH):
            if len(places) > 300_000 or not places:
                places.clear()
                places.new = []
                # By number: key, count among the top words (or 0), whether it is one, and its term.
                key, is_known, sure, term = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            joined = [b" ".join(s) for s in split]
            numbers = [np.fromiter(map(places.__getitem__, s), np.int64, len(s)) for s in split]
            more = [word_key(w) for w in places.new]
            found = [known.get(k) for k in more]
            places.new = []
            key = np.concatenate((key, np.array(more, np.int64)))
            is_known = np.concatenate((is_known, np.array([c is not None for c in found], np.int64)))
            sure = np.concatenate((sure, np.array([whole or c is not None for c in found], bool)))
            term = np.concatenate((term, np.array([unknown if c is None else terms[c] for c in found], np.float64)))
            base, n_known, tails, tail_counts = [], [], [], []
            for at in numbers:
                inside = sure[at]
                base.append(end_term + float(term[at[inside]].sum()))
                n_known.append((1 if ends else 0) + int(is_known[at].sum()))
                if inside.all():
                    tails.append([])
                    tail_counts.append([])
                else:
                    own, n = np.unique(at[~inside], return_counts=True)
                    tails.append(key[own])
                    tail_counts.append(n)
            columns = [batch.column(0).cast(pa.int64()), batch.column(2), pa.array([len(s) + 1 for s in split], pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scorer.texts(joined), pa.float64()), pa.array([len(t) + 1 for t in joined], pa.int64()), pa.array(tails, pa.list_(pa.int64())), pa.array(tail_counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "tail", "tail_n"])

    rows = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, tail array<bigint>, tail_n array<bigint>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "ctw-scored")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("row", F.col("x.tail").alias("key"), F.col("x.tail_n").alias("k"))
    term = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.5))
    more = tail.join(words, "key", "left").groupBy("row").agg(F.sum(F.col("k") * term).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(F.lit(0))).alias("more_known"))
    norm = math.log10(tokens + 0.5 * (distinct + 1))
    out = rows.drop("tail", "tail_n").join(more, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(LN10 / math.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
