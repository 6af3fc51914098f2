"""Order-dependent operators over a whole table, without sending the table to one task.

A row belongs to a bucket that follows the order, the buckets are summed (a row each), running sums over buckets give each its
start, and windows run inside buckets only. The table of buckets is the one thing that is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _starts(df: DataFrame, buckets: list[str], value: Column) -> DataFrame:
    own = df.groupBy(*buckets).agg(F.sum(value).alias("dg_sum"))
    before = Window.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    return own.select(*[F.col(b).alias(f"dg_{b}") for b in buckets], F.coalesce(F.sum("dg_sum").over(before), F.lit(0)).alias("dg_start"))


def prefix_sum(df: DataFrame, order: str, value: str, out: str, width: int = 65536) -> DataFrame:
    """Adds the sum of value over all rows before this one by an integer column, which tells rows apart. A null key comes first."""
    own = df.withColumn("dg_bucket", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    starts = _starts(own, ["dg_bucket"], F.col(value))
    inside = Window.partitionBy("dg_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = own.join(starts, own["dg_bucket"].eqNullSafe(starts["dg_dg_bucket"]))
    return met.withColumn(out, (F.col("dg_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("bigint")).drop("dg_bucket", "dg_dg_bucket", "dg_start")


def rank_by(df: DataFrame, buckets: dict[str, Column], order: list[Column], out: str) -> DataFrame:
    """Adds the place, from 0, of each row in an order whose first keys are the bucket columns."""
    names = [f"dg_b{i}" for i in range(len(buckets))]
    own = df.select("*", *[c.alias(n) for n, c in zip(names, buckets.values())])
    starts = _starts(own, names, F.lit(1))
    inside = Window.partitionBy(*names).orderBy(*order)
    on = [own[n].eqNullSafe(starts[f"dg_{n}"]) for n in names]
    met = own.join(starts, on)
    return met.withColumn(out, (F.col("dg_start") + F.row_number().over(inside) - 1).cast("bigint")).drop(*names, *[f"dg_{n}" for n in names], "dg_start")


def fill_gaps(keys: DataFrame, key: str, out: str = "is_free") -> DataFrame:
    """Every integer between the least and largest key, marked where no row has it."""
    ends = keys.agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a is not null")
    # One sequence a block of keys, so that no row holds them all.
    block = 65536
    blocks = ends.select("a", "b", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(block).cast("bigint"))).alias("s"))
    every = blocks.repartition("s").select(F.explode(F.sequence(F.col("s"), F.least("b", F.col("s") + block - 1))).alias(key))
    return every.join(keys.select(F.col(key).alias("dg_key")).distinct(), F.col(key) == F.col("dg_key"), "left").select(key, F.col("dg_key").isNull().alias(out))
