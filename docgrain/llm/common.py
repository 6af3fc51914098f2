"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import mmap
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.cluster import ship

__all__ = ["id_crc", "mapped_file", "no_cycles", "opened", "per_worker", "put_file", "quantile_bounds", "removed", "saved", "scratch", "shared_dir", "shielded", "ship", "shuffle_width", "small_batches", "table"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="docgrain-shared-")
        spark.sparkContext.setCheckpointDir(found)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(found)
    named = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + named[5:] if named.startswith("file:/") and not named.startswith("file://") else named


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a path of the shared folder and is needed no more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(docs: DataFrame):
    """The same rows with column names that clash with none made here, the new name of each, and what gives a result its names again."""
    names = {c: f"dg_in{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return plain, names, lambda df, *more: df.select(*[F.col(n).alias(c) for c, n in names.items()], *more)


def id_crc(doc_id):
    """crc32 of the decimal doc_id, as a column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def opened(path: str):
    """(file system, path inside it) for a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put_file(path: str, data: bytes) -> None:
    system, inside = opened(path)
    system.create_dir(os.path.dirname(inside), recursive=True)
    with system.open_output_stream(inside) as f:
        f.write(data)


def mapped_file(path: str) -> mmap.mmap:
    """A file mapped into memory, one copy for all workers of a machine. From a store that is no file system, a copy without a name is mapped."""
    system, inside = opened(path)
    if system.type_name == "local":
        with open(inside, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as own, system.open_input_stream(inside) as f:
        shutil.copyfileobj(f, own, 1 << 20)
        own.flush()
        return mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ)


_held: list = [None, None]


def released() -> None:
    """Gives memory that is free inside this worker back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_worker(key: str, make):
    """What this Python worker has made for a key, kept from one task to the next; the last key's only."""
    if _held[0] != key:
        _held[:] = [None, None]  # frees the last before the next is made
        released()
        _held[:] = [key, make()]
    return _held[1]


@contextlib.contextmanager
def no_cycles():
    """For code that makes many objects and no reference cycles: the search for cycles rests."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def small_batches(batches, most_bytes: int = 8 << 20):
    """The same rows in slices of about most_bytes at most, one row at least: bounds what a worker holds."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(1, batch.nbytes)))
        for start in range(0, n, step):
            yield batch.slice(start, step)


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Ascending distinct values of an integer column that cut its rows into about equal ranges: at most parts - 1 longs."""
    if parts < 2:
        return []
    cuts = df.select(F.col(column).cast("double").alias("v")).where("v is not null").approxQuantile("v", [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(x) for x in cuts})


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
