"""Classification ladders, conditional counters and small projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ladder(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(*[steps[0][0], F.lit(steps[0][1])])
    for condition, name in steps[1:]:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def counters(df: DataFrame, keys: list[str], size: str, marks: dict[str, Column], total: str = "total") -> DataFrame:
    """Rows and sizes of each group, and of each marked kind in it, in one pass."""
    own = []
    for name, mark in marks.items():
        own += [F.count_if(mark).alias(f"n_{name}"), F.coalesce(F.sum(F.when(mark, F.col(size))), F.lit(0)).cast("bigint").alias(f"{total}_{name}")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("bigint").alias(total), *own, F.max(size).alias("largest"))


def residual(df: DataFrame, keys: list[str], size: str, kinds: list[Column]) -> DataFrame:
    """What the sizes of the kinds, which don't overlap, leave of each group's total."""
    known = F.lit(0)
    for k in kinds:
        known = known + F.sum(F.when(k, F.col(size)).otherwise(0))
    return df.groupBy(*keys).agg(F.sum(size).cast("bigint").alias("total"), (F.sum(size) - known).cast("bigint").alias("structures"))


def with_embedded(parents: DataFrame, key: str, children: DataFrame, ref: str, columns: list[str]) -> DataFrame:
    """Parents with a row for each embedded child; those without any have one row of nulls."""
    return parents.join(children.select(F.col(ref).alias("dg_ref"), *columns), F.col(key) == F.col("dg_ref"), "left").drop("dg_ref")


def ordinals(df: DataFrame, key: str, order: str, out: str = "ordinal") -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("bigint"))


def distinct_names(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Distinct (kind, name) over columns of names, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in kinds.items()])
    return df.select(F.inline(pairs)).distinct()


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits, 0 for null and empty texts."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return 0.0
            _, n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            share = n / n.sum()
            return float(-(share * np.log2(share)).sum()) + 0.0

        return x.map(one, na_action=None)

    return run(text)


def chunks(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, part, chunk): a text cut to pieces of a width; the empty text has one empty piece."""
    parts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / F.lit(width)).cast("int"))
    return df.select(key, text, F.explode(parts).alias("i")).select(key, F.col("i").cast("bigint").alias("part"), F.substring(F.col(text), F.col("i") * width + 1, F.lit(width)).alias("chunk"))


def lenient_unhex(text: Column) -> Column:
    """Bytes of hex digits; other characters don't count, and a last odd digit is followed by 0."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))
