"""Choice of the cheapest encoding, and predictors that make data cheaper, on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docgrain.operators.sequence import Sequence


def cheapest(df: DataFrame, keys: list[str], costs: dict[str, Column]) -> DataFrame:
    """The least cost of each row and its candidate's name; of equal costs the first candidate. No row is made or moved."""
    options = [F.struct(c.cast("bigint").alias("cost"), F.lit(i).alias("ord"), F.lit(name).alias("name")) for i, (name, c) in enumerate(costs.items())]
    return df.select(*keys, F.least(*options).alias("best")).select(*keys, "best.cost", "best.name")


def bitmap_configurations(df: DataFrame, size: str) -> DataFrame:
    """All (bits, components, width) that fill a size of bytes exactly with one row; sixteen candidates a row, inside it."""
    candidates = [F.struct(F.lit(b).alias("bits"), F.lit(c).alias("components")) for b in (2, 4, 8, 16) for c in (1, 2, 3, 4)]
    each = df.where(F.col(size) > 0).select("*", F.inline(F.array(*candidates)))
    return each.where(F.col(size) * 8 % (F.col("bits") * F.col("components")) == 0).withColumn("width", F.floor(F.col(size) * 8 / (F.col("bits") * F.col("components"))).cast("bigint")).drop(size)


def delta(df: DataFrame, s: Sequence, value: str, out: str, modulus: int = 256) -> DataFrame:
    """Each value less the one before, modulo a byte."""
    return df.withColumn(out, F.pmod(F.col(value) - F.coalesce(F.lag(value).over(s.window()), F.lit(0)), F.lit(modulus)))


def undelta(df: DataFrame, s: Sequence, value: str, out: str, modulus: int = 256) -> DataFrame:
    """The values that `delta` had: running sums modulo a byte."""
    return df.withColumn(out, F.pmod(F.sum(value).over(s.before()), F.lit(modulus)))


def paeth_best(a: Column, b: Column, c: Column) -> Column:
    """Of left, above and upper left the one nearest to left + above - upper left, in this order."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def predicted(df: DataFrame, row: str, column: str, value: str, kind: str) -> DataFrame:
    """Pixels less their prediction: `up`, or `paeth` and `average`, modulo a byte. Outside the picture stands 0."""
    above = Window.partitionBy(column).orderBy(row)
    left = Window.partitionBy(row).orderBy(column)
    p = df.withColumn("dg_b", F.coalesce(F.lag(value).over(above), F.lit(0)))
    if kind == "up":
        return p.withColumn("up", F.pmod(F.col(value) - F.col("dg_b"), F.lit(256))).drop("dg_b")
    p = p.withColumn("dg_a", F.coalesce(F.lag(value).over(left), F.lit(0))).withColumn("dg_c", F.coalesce(F.lag("dg_b").over(left), F.lit(0)))
    a, b, c = (F.col(x) for x in ("dg_a", "dg_b", "dg_c"))
    out = p.withColumn("paeth", F.pmod(F.col(value) - paeth_best(a, b, c), F.lit(256))).withColumn("average", F.pmod(F.col(value) - F.floor((a + b) / 2).cast("bigint"), F.lit(256)))
    return out.drop("dg_a", "dg_b", "dg_c")


def channels(df: DataFrame, column: str, components: int) -> DataFrame:
    """Interleaved samples as (channel, place)."""
    return df.withColumn("channel", (F.col(column) % components).cast("bigint")).withColumn("place", F.floor(F.col(column) / components).cast("bigint"))
