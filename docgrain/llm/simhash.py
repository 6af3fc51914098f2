"""SimHash near-duplicate classes, found by deletion-variant signatures.

A text's fingerprint has bit b set if more than half of its word shingles' XXH64 hashes have it. Fingerprints link if at
most RADIUS bits differ. Four differing bits over three segments leave one segment with at most one; so of every segment
all variants with one bit deleted are indexed (22 + 21 + 21 = 64 variants of 64 bits), and two fingerprints within four
bits share at least one variant. A bit deleted from one half of a segment leaves the other half as it is: so fingerprints are
dealt by halves of segments, six rows each, and the task that gets a half makes the variants of the other half, sorts
them, and verifies the members of each against each other.

Only distinct fingerprints are compared: equal texts meet in one group-by, whatever their number. What a variant's members
give is not pairs but links that join the same components: a walk takes a member, links all those still unmet that are
within the radius, and goes on with these; and of the links of a half only those are kept that join what was not joined,
so that a cluster of k near copies makes k - 1 links there. A half that more than BLOCK fingerprints share is cut into
blocks, and every two blocks are compared in a task of their own.

The filter `first_of_classes` links texts whose sets of five-word shingles have a Jaccard likeness of 0.8 at least. Such sets differ
in 15 % of their fingerprints' bits, so its fingerprints are wider, and cut into as many segments as it takes for a pair of likeness
0.8 to have one with at most one differing bit in RECALL of all cases (more for likelier pairs); segments get longer with the number of texts, so that
chance meetings stay few. What meets by a variant of a segment is verified: by 128 bits of the fingerprints, which pass all such pairs but
one in ten thousand, and then by the whole sets, read from the shared folder. `exact` finds all links without fingerprints: two such sets
share one of the first fifth of their hashes in any common order (common ones last, else ascending), so these are dealt. Links that join nothing
new are not handed on.

Null and empty texts have the fingerprint zero, which links like any other. A null id is the least id only if all ids of a
component are null. Repeated rows come back each, and the filter keeps one. Other columns are kept whatever their names.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import opened, removed, saved, scratch, shielded, ship, small_batches

BITS, SEED = 64, 42
#: Of the 64-bit operator: (word, lowest bit, number of bits) of the segments, and the most differing bits.
SEGMENTS, RADIUS = ((0, 0, 22), (0, 22, 21), (0, 43, 21)), 4
#: Of the filter: hundredths of Jaccard likeness from which texts are near duplicates.
SIMILAR = 80
#: How many in one of the pairs of that likeness meet, the most differing ones of 128 bits of such a pair, and by how many standard
#: deviations all its bits may differ more than they should.
RECALL, CHECKED_BITS, CHECKED_SIGMA = 0.99, 40, 3.5
BLOCK, SMALL = 250_000, 32
#: Keys of dropped rows that are sent to every task, at most; more are joined.
MOST_BROADCAST = 1_000_000


def remixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit hashes that leaves no bit alone."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bits_over_half(h: np.ndarray, words_out: int, counts: np.ndarray) -> None:
    """Adds to counts (words_out, 64) how many of these hashes have each bit; words after the first take remixed hashes."""
    for k in range(words_out):
        counts[k] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        h = remixed(h)


def fingerprint(text: str, shingle: int = 4) -> int:
    """Of one text, as an unsigned 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: lower-cases A-Z only, splits at 9-13 and 32
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    hash_of = xxhash.xxh64_intdigest
    counts, block = np.zeros((1, BITS), np.int64), 1 << 16
    for at in range(0, n, block):  # bounds the memory a long text takes
        stop = min(n, at + block)
        bits_over_half(np.array([hash_of(line[a:b], SEED) for a, b in zip(starts[at:stop].tolist(), ends[at:stop].tolist())], np.uint64), 1, counts)
    return int.from_bytes(np.packbits(2 * counts[0] > n).tobytes(), "big")


def wide_fingerprint(hashes: np.ndarray, words_out: int) -> np.ndarray:
    """Of a set of hashes, as words_out unsigned 64-bit numbers."""
    counts = np.zeros((words_out, BITS), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits_over_half(hashes[at : at + (1 << 16)], words_out, counts)
    return np.packbits(2 * counts > len(hashes), axis=1).view(">u8").astype(np.uint64).reshape(words_out)


def with_fingerprints(docs: DataFrame, carry: list[str], shingle: int = 4, text: str = "text") -> DataFrame:
    """The carried columns and dg_fp: the fingerprint as a signed long; no shuffle."""
    ship(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("dg_text"), *[F.col(f"`{c}`") for c in carry])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:]), "dg_fp long"])

    def run(batches):
        for batch in small_batches(batches, 2 << 20):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*carry, "dg_fp"])

    return own.mapInArrow(run, schema)


def bit_differs(least: int) -> float:
    """The probability that a fingerprint's bit differs between sets of a Jaccard likeness of least hundredths."""
    return math.acos(2 * least / (100 + least)) / math.pi


def planned(n: int, least: int = SIMILAR, recall: float = RECALL) -> tuple[tuple[tuple[int, int, int], ...], int]:
    """Segments for n texts, and the words of the fingerprints that they cut.

    A bit of two sets differs with the probability of their angle. A segment is three bits longer than n needs to tell texts apart, so
    that a text meets a few by chance, whatever n.
    """
    differs = bit_differs(least)
    m = min(32, max(21, math.ceil(math.log2(max(2, n))) + 3))
    meets = (1 - differs) ** m + m * differs * (1 - differs) ** (m - 1)
    count, each = math.ceil(math.log(1 - recall) / math.log(1 - meets)), BITS // m
    return tuple((i // each, i % each * m, m) for i in range(count)), max(2, -(-count // each))


def halves(segments) -> list[tuple[int, int, int, int, int]]:
    """(word, lowest bit, bits, the other half's lowest bit, its bits) of both halves of all segments."""
    out = []
    for word, low, n in segments:
        m = n // 2
        out += [(word, low, m, low + m, n - m), (word, low + m, n - m, low, m)]
    return out


def half_keys(segments) -> Column:
    """Array of the halves' values of dg_w, each with the half's number above it, and the values of the other halves."""
    cut = lambda word, low, n: F.shiftrightunsigned(F.get("dg_w", F.lit(word)), low).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    return F.array(*[F.struct((cut(word, low, n) + F.lit(i << 16)).alias("half"), cut(word, other, m).alias("other")) for i, (word, low, n, other, m) in enumerate(halves(segments))])


def variants(half: np.ndarray, other: np.ndarray, segments) -> tuple[np.ndarray, np.ndarray]:
    """For rows with the number of the half that they are dealt by, and the other half: (row, variant) of all one-bit deletions of the latter."""
    rows, keys = [], []
    for i, (_, _, _, _, n) in enumerate(halves(segments)):
        at = np.flatnonzero(half == i)
        if not len(at):
            continue
        value = other[at].astype(np.uint64)
        for b in range(n):
            rows.append(at)
            keys.append((value & ~np.uint64(1 << b)) | np.uint64(b << 16))
    return np.concatenate(rows), np.concatenate(keys)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links, in their order, join what those before them did not."""
    parent: dict[int, int] = {}
    keep = np.zeros(len(a), bool)

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def walk(fp: np.ndarray, radius: int, side: np.ndarray | None = None, verify=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to), as places, that join the same components as all pairs within the radius do. fp: (members, words).

    With side, only pairs of different sides count; those of one side are found elsewhere. With verify, of pairs within the radius those count
    that it takes, given a place and an array of places.
    """
    unmet, found_a, found_b = np.arange(len(fp)), [], []
    queue: list[int] = []
    while len(unmet):
        if not queue:
            queue.append(int(unmet[0]))
            unmet = unmet[1:]
        at = queue.pop()
        near = np.bitwise_count(fp[unmet] ^ fp[at]).sum(axis=1) <= radius
        if side is not None:
            near &= side[unmet] != side[at]
        if verify is not None and near.any():
            near[near] = verify(at, unmet[near])
        if near.any():
            to = unmet[near]
            found_a.append(np.full(len(to), at))
            found_b.append(to)
            queue += to.tolist()
            unmet = unmet[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate(found_a or [none]), np.concatenate(found_b or [none])


def group_links(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, verify=None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys. side: 0 of an undivided half or a block of its own, 1 and 2 of two blocks that are compared; ascending in a run."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    left = np.repeat(first + size, size) - np.arange(len(key))  # members from here to the end of the run
    small = np.repeat(size <= SMALL, size) & (side == 0)
    out_a, out_b = [], []
    at, step = np.flatnonzero(small & (left > 1)), 1
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]).sum(axis=1) <= radius]
        if verify is not None and len(near):
            near = near[np.concatenate([verify(x, np.array([x + step])) for x in near.tolist()])]
        out_a.append(near)
        out_b.append(near + step)
        step += 1
        at = at[left[at] > step]
    for i in np.flatnonzero((size > SMALL) & (side[first] == 0) | (side[first] != side[first + size - 1])):
        a, b = first[i], first[i] + size[i]
        inside = None if verify is None else lambda i, others, a=a: verify(i + a, others + a)
        found = walk(fp[a:b], radius, side[a:b] if side[a] else None, inside)
        out_a.append(found[0] + a)
        out_b.append(found[1] + a)
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def links(points: DataFrame, segments=SEGMENTS, radius: int = RADIUS, block: int = BLOCK, folder: str | None = None, least: int = SIMILAR) -> DataFrame:
    """(a, b) of names, a < b: links that join the same components as all pairs that share a variant and are within the radius.

    points: (name, dg_w), the names distinct, dg_w the words of the fingerprint; the radius is of the first two. With a folder, names are
    places of sets there, dg_n the sizes, and such pairs count that have a Jaccard likeness of least hundredths.
    """
    spark = points.sparkSession
    ship(spark)
    words = 1 + max(w for w, _, _ in segments)
    columns = [f"dg_w{i}" for i in range(min(2, words))] + ["dg_n"] * (folder is not None)
    index = points.select("name", *[F.get("dg_w", F.lit(i)).alias(f"dg_w{i}") for i in range(min(2, words))], *["dg_n"] * (folder is not None), F.explode(half_keys(segments)).alias("at"))
    index = index.select("name", *columns, "at.half", "at.other")
    columns = [*columns, "other"]
    differs = bit_differs(least)
    most_bits = BITS * words * differs + CHECKED_SIGMA * math.sqrt(BITS * words * differs * (1 - differs))
    # Halves of more fingerprints than a block, counted with sums by task; mostly none.
    hot = saved(index.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("half", F.ceil(F.col("n") / block).cast("int").alias("parts")), "hot-halves")
    whole = lambda df: df.select(F.col("half").cast("long").alias("task"), "half", F.lit(0).alias("side"), "name", *columns)
    if hot.limit(1).count():
        tasks = index.join(hot, "half").withColumn("own", F.pmod(F.xxhash64("name"), "parts").cast("int"))
        # The task of two blocks has the members of both, that of one block its own.
        tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        split = tasks.select(F.xxhash64("half", low, high).alias("task"), "half", side.alias("side"), "name", *columns)
        rest = whole(index.join(hot, "half", "left_anti")).union(split)
    else:
        rest = whole(index)
    dealt = rest.repartition("task").sortWithinPartitions("task")

    def run(batches):
        held, sets = None, Sets(folder, words) if folder else None
        parent: dict[int, int] = {}  # of what this task has joined

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def out(task, half, side, name, *rest):
            *prints, other = rest
            sizes = prints.pop() if folder else None
            row, key = variants(half >> 16, other, segments)
            order = np.lexsort((side[row], key, task[row]))
            row, key = row[order], key[order]
            # Runs of equal (task, variant) are told by numbers of their own.
            new = np.concatenate(([False], (key[1:] != key[:-1]) | (task[row[1:]] != task[row[:-1]])))
            verify = None
            if folder:
                own = np.stack((name, sizes), axis=1)[row]

                def verify(i: int, others: np.ndarray) -> np.ndarray:
                    a, n = own[i].tolist()
                    took = np.zeros(len(others), bool)
                    places = own[others, 0].tolist()
                    close = np.bitwise_count(sets.wide(places) ^ sets.wide([a])).sum(axis=1) <= most_bits
                    for k in np.flatnonzero(close).tolist():
                        b, m = own[others[k]].tolist()
                        p, q = root(a), root(b)
                        if p != q and 100 * min(n, m) >= least * max(n, m):
                            x, y = sets.read(a, n), sets.read(b, m)
                            shared = n + m - len(np.union1d(x, y))
                            if 100 * shared >= least * (n + m - shared):
                                parent[max(p, q)] = min(p, q)
                                p = q
                        took[k] = p == q
                    return took

            fp = np.stack([w.view(np.uint64) for w in prints], axis=1)
            a, b = group_links(np.cumsum(new), side[row], fp[row], radius, verify)
            a, b = row[a], row[b]
            keep = spanning(a, b)
            a, b = name[a[keep]], name[b[keep]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            part = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(part[0]):
                continue
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part))
            if len(held[0]) < 1 << 15:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last task may go on
            if cut:
                yield out(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield out(*held)

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(name, root) for every name in edges (a < b): root is the least name reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each written to the shared folder, until the edges no longer
    change: then every edge leads to its root. Rounds grow with the logarithm of the longest chain.
    """
    edges = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")

    def state(e):
        x = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return x["n"], x["h"]

    before = state(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Small star: each larger end points to its least smaller neighbour, and so do its other smaller neighbours.
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("p"), F.explode(F.array("u", "v")).alias("q")).where("p < q").select(F.col("p").alias("u"), F.col("q").alias("v")).distinct()
        edges = saved(small, "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("name"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("name"), F.col("u").alias("root")).distinct())


def classes(docs: DataFrame, carry: list[str] | None = None, shingle: int = 4, segments=SEGMENTS, radius: int = RADIUS, block: int = BLOCK, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The carried columns (the id unless told otherwise), the fingerprint's and component_id, one row for each row.

    component_id is the least id reachable over links, the row's own included.
    """
    carry = [id_column] if carry is None else carry
    columns = list(dict.fromkeys([id_column, *carry]))
    rows = saved(with_fingerprints(docs, columns, shingle, text), "fingerprints")
    # A class of equal fingerprints has a number as name, as ids may be null or repeat.
    reps = rows.groupBy("dg_fp").agg(F.min(F.col(f"`{id_column}`")).alias("low"))
    reps = saved(reps.withColumn("name", F.monotonically_increasing_id()), "classes")
    found = saved(components(links(reps.select("name", F.array("dg_fp").alias("dg_w")), segments, radius, block)), "components")
    # The classes that have links, few of all, take the least id of their component.
    low = found.join(reps.select("name", "low"), "name")
    moved = low.join(low.groupBy("root").agg(F.min("low").alias("root_low")), "root").select("name", "root", "root_low")
    of_fps = reps.join(moved, "name", "left").select("dg_fp", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("root_low")).alias("component_id"))
    return rows.join(of_fps, "dg_fp").select(*[F.col(f"`{c}`") for c in carry], "dg_fp", "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends, hash_of = ends[min(shingle, len(words)) - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_of(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends)))


class Sets:
    """Shingle sets in files of the shared folder, read by place: a file's number and, in the low 40 bits, the first hash in it.

    The words of a set's fingerprint stand before its hashes. What was read last is kept, up to a bound.
    """

    def __init__(self, folder: str, words: int = 0):
        self.folder, self.words, self.files = folder, words, {}
        self.sets: dict[int, np.ndarray] = {}
        self.prints: dict[int, np.ndarray] = {}
        self.held = 0

    def get(self, place: int, n: int) -> np.ndarray:
        number = place >> 40
        if number not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            system, inside = opened(f"{self.folder}/{number}.sets")
            self.files[number] = system.open_input_file(inside)
        return np.frombuffer(self.files[number].read_at(8 * n, 8 * (place & ((1 << 40) - 1))), np.uint64)

    def read(self, place: int, n: int) -> np.ndarray:
        found = self.sets.get(place)
        if found is None or len(found) < n:
            if self.held > 1 << 22:
                self.sets.clear()
                self.held = 0
            found = self.sets[place] = self.get(place, n)
            self.held += n
        return found[:n]

    def wide(self, places: list[int]) -> np.ndarray:
        """The fingerprints of these sets, a row each."""
        if len(self.prints) > 100_000:
            self.prints.clear()
        for x in places:
            if x not in self.prints:
                self.prints[x] = self.get(x - self.words, self.words)
        return np.stack([self.prints[x] for x in places])


def common_shingles(docs: DataFrame, shingle: int, text: str) -> np.ndarray:
    """Hashes of shingles that many texts have, by a sample: these come last in the order of sets. What the sample misses costs time and no links."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in small_batches(batches, 2 << 20):
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], names=["h"])

    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(16)) == 0).distinct()
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(200_000).toArrow().column(0).to_numpy().view(np.uint64))


def with_sets(docs: DataFrame, carry: list[str], shingle: int, text: str, folder: str, words_out: int, common: np.ndarray | None = None) -> DataFrame:
    """The carried columns, dg_a and dg_b (a 128-bit hash of the shingle set), dg_n (its size), dg_place and, with words_out, the words dg_w of
    its fingerprint. The sets go to files, one of each task attempt. common: hashes that come last in the sets' order."""
    ship(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("dg_text"), *[F.col(f"`{c}`") for c in carry])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:]), "dg_a long, dg_b long, dg_n long, dg_place long, dg_w array<bigint>"])
    last_ones = None if common is None else docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        number, at = TaskContext.get().taskAttemptId(), 0
        system, inside = opened(f"{folder}/{number}.sets")
        system.create_dir(os.path.dirname(inside), recursive=True)
        with system.open_output_stream(inside) as f:
            for batch in small_batches(batches, 2 << 20):
                rows, wide = [], []
                for t in batch.column(0).to_pylist():
                    held = shingle_set(t, shingle)
                    wide.append(wide_fingerprint(held, words_out).view(np.int64) if words_out else np.zeros(0, np.int64))
                    if last_ones is not None:
                        last = np.isin(held, last_ones.value)
                        held = np.concatenate((held[~last], held[last]))
                    f.write(wide[-1].tobytes())
                    f.write(held.tobytes())
                    at += words_out
                    h = xxhash.xxh3_128_digest(held.tobytes())
                    rows.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), len(held), number << 40 | at))
                    at += len(held)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(list(c), pa.int64()) for c in zip(*rows)), pa.array(wide, pa.list_(pa.int64()))], names=[*carry, "dg_a", "dg_b", "dg_n", "dg_place", "dg_w"])

    return own.mapInArrow(run, schema)


def alike(least: int, n: int) -> int:
    """Of sets of n, the fewest shared members that a likeness of SIMILAR hundredths allows: at least that share of the larger set."""
    return -(-least * n // 100)


def run_links(names: np.ndarray, sizes: np.ndarray, sets: Sets, least: int, root) -> list[tuple[int, int]]:
    """Links of the members of one run that join the same components as all its pairs of a Jaccard likeness of least hundredths, given what root knows as joined."""
    out, unmet, queue = [], np.arange(len(names)), []
    while len(unmet):
        if not queue:
            queue.append(int(unmet[0]))
            unmet = unmet[1:]
        at = queue.pop()
        mine, n, met = None, int(sizes[at]), np.zeros(len(unmet), bool)
        for i, other in enumerate(unmet.tolist()):
            if root(int(names[other])) == root(int(names[at])):
                met[i] = True  # joined already, and goes on
                continue
            m = int(sizes[other])
            if 100 * min(n, m) < least * max(n, m):
                continue
            mine = sets.read(int(names[at]), n) if mine is None else mine
            shared = n + m - len(np.union1d(mine, sets.read(int(names[other]), m)))
            if 100 * shared >= least * (n + m - shared):
                met[i] = True
                out.append((int(names[at]), int(names[other])))
        queue += unmet[met].tolist()
        unmet = unmet[~met]
    return out


def set_links(reps: DataFrame, folder: str, least: int = SIMILAR) -> DataFrame:
    """(a, b) of names, a < b: links that join the same components as all pairs of a Jaccard likeness of least hundredths at least.

    Two such sets share so many members that they share one of the first n - alike(n) + 1 of each in any common order; these are dealt, and
    the sets of those that meet are read and compared whole. reps: (name, dg_n), the name a place in the folder.
    """

    def prefixes(batches):
        sets = Sets(folder)
        for batch in small_batches(batches, 1 << 16):
            names, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            first = [sets.read(int(x), int(n) - alike(least, int(n)) + 1) for x, n in zip(names, sizes)]
            k = [len(x) for x in first]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(names, k)), pa.array(np.repeat(sizes, k))], names=["token", "name", "dg_n"])

    def run(batches):
        sets, parent = Sets(folder), {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def out(held):
            token, name, size = held
            edges = np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1, [len(token)]))
            found = []
            for i in np.flatnonzero(np.diff(edges) > 1).tolist():
                a, b = edges[i], edges[i + 1]
                for x, y in run_links(name[a:b], size[a:b], sets, least, root):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.append((min(x, y), max(x, y)))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        held = None
        for batch in batches:
            part = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part))
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last run may go on
            if cut:
                yield out(tuple(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield out(held)

    dealt = reps.where("dg_n > 0").select("name", "dg_n").sortWithinPartitions("name").mapInArrow(prefixes, "token long, name long, dg_n long")
    return dealt.repartition("token").sortWithinPartitions("token", "name").mapInArrow(run, "a long, b long")


def alike_classes(docs: DataFrame, carry: list[str], shingle: int, id_column: str, text: str, exact: bool = False, block: int = BLOCK) -> DataFrame:
    """The carried columns and dg_class, a number for each component of texts whose shingle sets are alike; the sets are deleted at the end."""
    folder = scratch(docs.sparkSession, "shingle-sets")
    segments, words = planned(docs.count())
    rows = saved(with_sets(docs, carry, shingle, text, folder, 0 if exact else words, common_shingles(docs, shingle, text) if exact else None), "shingled")
    # One of each set.
    reps = saved(rows.groupBy("dg_a", "dg_b", "dg_n").agg(F.min(F.struct("dg_place", "dg_w")).alias("s")).select("dg_a", "dg_b", "dg_n", F.col("s.dg_place").alias("name"), F.col("s.dg_w").alias("dg_w")), "classes")
    linked = set_links(reps, folder) if exact else links(reps.where("dg_n > 0").select("name", "dg_w", "dg_n"), segments, CHECKED_BITS, block, folder)
    found = saved(components(linked).select("name", "root"), "components")
    removed(docs.sparkSession, folder)
    # Few sets have links; a set without any is a class by itself.
    named = reps.join(found, "name", "left").select("dg_a", "dg_b", F.coalesce("root", F.when(F.col("dg_n") > 0, F.col("name")).otherwise(F.lit(-1))).alias("dg_class"))
    return rows.join(named, ["dg_a", "dg_b"]).select(*[F.col(f"`{c}`") for c in carry], "dg_class")


def first_of_classes(docs: DataFrame, shingle: int = 5, id_column: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """One row of each class, all columns kept: that with the least id and, of repeated ids, the least hash of the text.

    Which rows stay is decided on ids and hashes; the rows are then met by a 128-bit hash of id and text.
    """
    plain, names, back = shielded(docs)
    own, body = names[id_column], names[text]
    key = ["dg_row", "dg_row2"]
    keyed = plain.withColumn("dg_row", F.xxhash64(F.col(own), F.col(body))).withColumn("dg_row2", F.xxhash64(F.lit(1), F.col(body), F.col(own)))
    found = alike_classes(keyed, [own, *key], shingle, own, body, exact)
    # By the class and not its least id, which other classes may have as well, or none. Null ids come last.
    keep = found.groupBy("dg_class").agg(F.min(F.struct(F.col(own).isNull(), F.col(own), *key)).alias("s"))
    keep = keep.select(*[F.col(f"s.{k}").alias(k) for k in key]).distinct()
    # The keys of rows that go, 16 bytes each, are the smaller set: sent to all tasks up to a bound, so that texts stay where they are.
    drop = saved(found.select(*key).distinct().join(keep, key, "left_anti"), "dropped")
    few = drop.count() <= MOST_BROADCAST
    # Rows that repeat both id and text are one.
    again = found.groupBy(*key).count().where("count > 1").limit(1).count() > 0
    met = keyed.join(F.broadcast(drop) if few else drop, key, "left_anti")
    return back(met.dropDuplicates(key) if again else met)
