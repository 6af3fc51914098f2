"""References between rows: used and unused targets, translation through tables, reachability, last versions."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def used(targets: DataFrame, key: str, refs: DataFrame, ref: str) -> DataFrame:
    return targets.join(refs.select(F.col(ref).alias("dg_ref")).distinct(), F.col(key) == F.col("dg_ref"), "left_semi")


def unused(targets: DataFrame, key: str, refs: DataFrame, ref: str) -> DataFrame:
    return targets.join(refs.select(F.col(ref).alias("dg_ref")).distinct(), F.col(key) == F.col("dg_ref"), "left_anti")


def translate(df: DataFrame, column: str, names: DataFrame, old: str, new: str, out: str) -> DataFrame:
    """Adds the new name of a column's value by a table of names, or the value itself."""
    t = names.select(F.col(old).alias("dg_old"), F.col(new).alias("dg_new"))
    return df.join(t, F.col(column) == F.col("dg_old"), "left").withColumn(out, F.coalesce(F.col("dg_new").cast("string"), F.col(column))).drop("dg_old", "dg_new")


def last_versions(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row for each key, with the columns of its last row; summed by task, no sort."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("dg_last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"dg_last.{c}").alias(c) for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="docgrain-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, to cut lineage in loops."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def until_no_change(step: Callable[[DataFrame], DataFrame], start: DataFrame, rounds: int | None = None) -> DataFrame:
    """Apply a step until it gives no new rows or, if asked, so many times at most. Each result is written, so plans stay short."""
    now = written(start)
    count = now.count()
    for _ in itertools.count() if rounds is None else range(rounds):
        then = written(step(now))
        grown = then.count()
        if grown == count:
            return then
        now, count = then, grown
    return now


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int | None = None) -> DataFrame:
    """(src, dst, depth): all that is reachable over edges (in rounds + 1 steps at most, if asked), with the least number of steps.

    Each round joins only the pairs that the round before found, so no pair is extended twice; cycles end it.
    """
    e = edges.select(F.col(src).alias("e_src"), F.col(dst).alias("e_dst")).distinct()
    found = written(e.select(F.col("e_src").alias("src"), F.col("e_dst").alias("dst"), F.lit(1).cast("bigint").alias("depth")))
    last = found
    for depth in itertools.count(2) if rounds is None else range(2, rounds + 2):
        more = last.join(e, last["dst"] == e["e_src"]).select("src", F.col("e_dst").alias("dst")).distinct()
        new = written(more.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if new.isEmpty():
            return found
        found, last = found.unionByName(new), new
    return found
