"""Toxicity of texts: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (of <word>, 3 to 6 characters, and the word itself),
a text the mean of its words, and a softmax over two classes reads it. All vectors and the softmax learn together. A
misspelling never seen shares most n-grams with its word, and so most of its vector.

The model is fitted on the driver to a bounded sample: at most MOST_EACH labelled texts of each class, those whose ids come
first by a hash. It is then a table of 2 ** BUCKET_BITS floats (the softmax's difference applied to every n-gram), which is
all that scoring needs and has that size for any input.

Null and empty texts have no words and get the softmax of its bias. Null ids and repeated rows are scored like others;
labels without a value, or for ids that no document has, aren't used. Without a label of each class every score is the
share of toxic labels, kept a millionth away from 0 and 1 (a millionth if there are no labels).
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, per_worker, scratch, shielded, ship, small_batches
from .warc import opened

BUCKET_BITS, DIM, SHORTEST, LONGEST = 17, 4, 3, 6
MOST_EACH = 3000
EPOCHS, BATCH, RATE, SHRINK, SEED = 20, 256, 0.2, 0.9, 7
FOLDS = 5


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of many words' character n-grams and of the words themselves, whose word each belongs to, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters from here to the word's end
    shift = np.uint64(64 - BUCKET_BITS)
    whole = np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked], np.uint64)
    buckets, owners = [mixed(whole) >> shift], [np.arange(len(words))]
    h = points.copy()
    for n in range(2, LONGEST + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n >= SHORTEST:
            inside = left[:m] >= n
            buckets.append(mixed(h[inside] + np.uint64(n)) >> shift)
            owners.append(owner[:m][inside])
    at = np.concatenate(owners)
    return np.concatenate(buckets).astype(np.int32), at, np.bincount(at, minlength=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit words with their bits spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Model:
    """What scoring needs: for each bucket the logit it adds, and the bias."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias

    def words(self, words: list[str]) -> np.ndarray:
        """The logit that each word adds: the mean over its n-grams."""
        out = []
        for at in range(0, len(words), 10_000):
            buckets, owners, sizes = grams_of(words[at : at + 10_000])
            out.append(np.bincount(owners, self.logits[buckets], len(sizes)) / sizes)
        return np.concatenate(out) if out else np.zeros(0)


def gram_row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text as a sparse row over buckets: (buckets, shares), ascending; the shares sum to one."""
    counts: dict[str, int] = {}
    for word in words_of(text):
        counts[word] = counts.get(word, 0) + 1
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, owners, sizes = grams_of(list(counts))
    own, back = np.unique(buckets, return_inverse=True)
    c = np.fromiter(counts.values(), np.float64, len(counts))
    return own, np.bincount(back, (c / c.sum() / sizes)[owners], len(own)).astype(np.float32)


def fit(begin: np.ndarray, end: np.ndarray, columns: np.ndarray, shares: np.ndarray, toxic, epochs: int = EPOCHS) -> Model:
    """Train on sparse rows with 0/1 marks; a row's buckets and shares stand from begin to end. Both arrays are changed. Training is by minibatches of Adam, both classes of equal weight; deterministic.

    N-grams whose gradient has no steady sign are noise: after each step every vector is shrunk towards zero by SHRINK of
    a step's length, so that only those of a steady sign stay (a group lasso). Frequent n-grams are scaled down by the
    root of their root mean square, as they vary most.
    """
    y = np.array(toxic, np.int64)
    table = np.zeros(1 << BUCKET_BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(table, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    parts = [slice(i, i + (1 << 20)) for i in range(0, len(columns), 1 << 20)]  # what is made on the way stays small
    texts, squares = np.zeros(len(table), np.int64), np.zeros(len(table))
    for part in parts:
        texts += np.bincount(columns[part], minlength=len(table))
        squares += np.bincount(columns[part], shares[part].astype(np.float64) ** 2, len(table))
    found = np.flatnonzero(texts)
    if not len(found):
        return Model(table, 0.0)
    n = len(found)
    place = np.zeros(len(table), np.int32)
    place[found] = np.arange(n)
    scale = 1 / np.sqrt(np.sqrt(squares[found] / len(y)))
    scale[texts[found] < 2] = 0  # n-grams of one text say nothing about others
    for part in parts:
        columns[part] = place[columns[part]]
        shares[part] *= scale[columns[part]]
    rng = np.random.default_rng(SEED)
    params = [rng.normal(0, 1e-3, (n, DIM)), rng.normal(0, 1, (DIM, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    size, step = max(8, min(BATCH, len(y) // 10)), 0
    total, offset, steps = np.zeros(n), 0.0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs) + 0.02 * RATE
        for at in range(0, len(y), size):
            chosen = np.sort(order[at : at + size])
            held = np.concatenate([np.arange(begin[i], end[i]) for i in chosen])
            row = np.repeat(np.arange(len(chosen)), end[chosen] - begin[chosen])
            col, val = columns[held], shares[held]
            e, w, bias = params
            x = np.stack([np.bincount(row, val * e[col, k], len(chosen)) for k in range(DIM)], 1)
            z = x @ w + bias
            d = np.exp(z - z.max(1, keepdims=True))
            d /= d.sum(1, keepdims=True)
            d[np.arange(len(chosen)), y[chosen]] -= 1
            d *= (weight[chosen] / len(chosen))[:, None]
            dx = d @ w.T
            grads = [np.stack([np.bincount(col, val * dx[row, k], n) for k in range(DIM)], 1), x.T @ d, d.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            length = np.sqrt((e * e).sum(1, keepdims=True)) + 1e-12
            e *= np.maximum(0, 1 - rate * SHRINK / length)
            if 2 * epoch >= epochs:  # the model is the mean of the second half's steps
                total += e @ (w[:, 1] - w[:, 0])
                offset += bias[1] - bias[0]
                steps += 1
    table[found] = total / steps * scale
    return Model(table, float(offset / steps))


def train(docs: DataFrame, labels: DataFrame, most_each: int = MOST_EACH) -> Model:
    """Fit on at most most_each labelled texts of each class, none of them held out."""
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("dg_id"), F.col("toxic").alias("dg_y")).where("dg_id is not null and dg_y in (0, 1)").where(id_crc(F.col("dg_id")) % FOLDS != 0)
    usable = usable.groupBy("dg_id").agg(F.max("dg_y").cast("int").alias("dg_y"))
    order = F.xxhash64("dg_id", F.lit(SEED))
    sample = None
    for mark in (0, 1):
        part = usable.where(F.col("dg_y") == mark).orderBy(order, "dg_id").limit(most_each)
        sample = part if sample is None else sample.union(part)

    def rows(batches):
        for batch in small_batches(batches, 1 << 20):
            ids, texts, marks = (c.to_pylist() for c in batch.columns)
            found = [gram_row(t) for t in texts]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in found]))), pa.int32()), pa.array(np.concatenate([r[i] for r in found]))) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), *lists], names=["id", "y", "g", "s"])

    # The sample has 2 * most_each ids: a proven bound for the broadcast.
    texts = docs.select(F.col("doc_id").alias("dg_id"), F.coalesce("text", F.lit("")).alias("dg_text")).join(F.broadcast(sample), "dg_id")
    # The rows are written and read again by the driver's Python, so that they don't pass through the driver's JVM.
    path = scratch(docs.sparkSession, "toxicity-sample")
    texts.select(F.col("dg_id").cast("long"), "dg_text", "dg_y").mapInArrow(rows, "id long, y int, g array<int>, s array<float>").write.parquet(path)
    system, inside = opened(path)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(inside)) if f.path.endswith(".parquet"))
    ids, toxic, sizes, columns, shares = [], [], [], [], []
    for file in files:
        with system.open_input_file(file) as f:
            got = pq.ParquetFile(f)
            for batch in got.iter_batches(batch_size=256):
                g, s = batch.column("g"), batch.column("s")
                ids += batch.column("id").to_pylist()
                toxic += batch.column("y").to_pylist()
                sizes.append(np.diff(g.offsets.to_numpy()))
                columns.append(g.flatten().to_numpy().astype(np.int32))
                shares.append(s.flatten().to_numpy().astype(np.float32))
    if not ids:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64))
    ids, toxic, sizes = np.array(ids), np.array(toxic), np.concatenate(sizes)
    all_columns = np.concatenate(columns)
    del columns
    all_shares = np.concatenate(shares)
    del shares
    end = np.cumsum(sizes)
    # In the order of ids, so that the model does not depend on the plan; rows that repeat an id count once.
    order = np.lexsort((sizes, ids))
    order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
    return fit((end - sizes)[order], end[order], all_columns, all_shares, toxic[order])


class Lookup:
    """Words met by a worker, each with a number and the logit that it adds; begun anew when there are too many."""

    def __init__(self, model: Model, most: int = 250_000):
        class Places(dict):
            def __missing__(self, word: str) -> int:
                n = self[word] = len(self)
                self.new.append(word)
                return n

        self.model, self.most, self.places, self.logit, self.known = model, most, Places(), np.zeros(1 << 12), 0
        self.places.new = []

    def trim(self) -> None:
        if len(self.places) > self.most:
            self.places.clear()
            self.known = 0

    def logits(self) -> np.ndarray:
        """By number, those of words that are new included."""
        n = len(self.places)
        while len(self.logit) < n:
            self.logit = np.concatenate((self.logit, np.zeros_like(self.logit)))
        self.logit[self.known : n] = self.model.words(self.places.new)
        self.known, self.places.new = n, []
        return self.logit


def scored(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns and dg_score, the probability that the text is toxic; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((model.logits, model.bias))
    key = f"toxicity-{uuid.uuid4().hex}"
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("dg_text"), *[F.col(f"`{c}`") for c in carry])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:]), "dg_score double"])

    def run(batches):
        table = Model(*held.value)

        lookup = per_worker(key, lambda: Lookup(table))
        places = lookup.places
        for batch in small_batches(batches, 1 << 20):
            lookup.trim()
            numbers = []
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                numbers.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
            logit = lookup.logits()
            z = np.array([table.bias + (float(logit[at].sum()) / len(at) if len(at) else 0.0) for at in numbers])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*carry, "dg_score"])

    return own.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most_each: int = MOST_EACH) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, most_each)
    rows = scored(docs, model, ["doc_id"])
    return rows.select("doc_id", (id_crc(F.col("doc_id")) % FOLDS == 0).alias("held_out"), F.col("dg_score").alias("score"), (F.col("dg_score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, most_each: int = MOST_EACH) -> DataFrame:
    """The rows whose score is under one half, all columns kept."""
    model = train(docs, labels, most_each)
    plain, names, back = shielded(docs)
    return back(scored(plain, model, plain.columns, names["text"]).where("dg_score < 0.5"))
