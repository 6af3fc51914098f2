"""Rewrites of ordered command sequences: one row a command, a key for each sequence, an order inside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Sequence:
    """Which column names a sequence and which order its rows; the order must tell rows apart."""

    key: str
    order: tuple[str, ...]

    def window(self):
        return Window.partitionBy(self.key).orderBy(*self.order)

    def before(self, to: int = 0):
        return self.window().rowsBetween(Window.unboundedPreceding, to)

    def after(self, start: int = 0):
        return self.window().rowsBetween(start, Window.unboundedFollowing)


def overwritten_removed(df: DataFrame, s: Sequence, op: str) -> DataFrame:
    """Drops a command that the next one of the same kind overwrites: a run keeps its last row."""
    return df.withColumn("dg_next", F.lead(op).over(s.window())).where(F.col("dg_next").isNull() | (F.col("dg_next") != F.col(op))).drop("dg_next")


def state_changes(df: DataFrame, s: Sequence, value: str) -> DataFrame:
    """Keeps commands that change the state: the first, and those of another value than the one before."""
    return df.withColumn("dg_last", F.lag(value).over(s.window())).where(F.col("dg_last").isNull() | (F.col("dg_last") != F.col(value))).drop("dg_last")


def last_value(df: DataFrame, s: Sequence, value: Column, out: str) -> DataFrame:
    """Adds the last value that was set up to each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(s.before()))


def runs(df: DataFrame, s: Sequence, op: str, out: str = "run") -> DataFrame:
    """Numbers the runs of equal neighbours of each sequence from 1."""
    new = F.when(F.lag(op).over(s.window()).eqNullSafe(F.col(op)), 0).otherwise(1)
    return df.withColumn("dg_new", new).withColumn(out, F.sum("dg_new").over(s.before()).cast("bigint")).drop("dg_new")


def merged_runs(df: DataFrame, s: Sequence, op: str, text: Column) -> DataFrame:
    """One row a run: its place, kind, length, and texts joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(*s.order, text.alias("dg_text"))))
    grouped = runs(df, s, op).groupBy(s.key, "run", op).agg(F.count(F.lit(1)).alias("n"), parts.alias("dg_parts"))
    return grouped.withColumn("merged", F.array_join(F.transform("dg_parts", lambda x: x["dg_text"]), ",")).drop("dg_parts")


def split_runs(df: DataFrame, s: Sequence, op: str, most: int = 128) -> DataFrame:
    """Run lengths of each sequence, longer ones cut at most: (key, run, part, op, n)."""
    n = runs(df, s, op).groupBy(s.key, "run", op).agg(F.count(F.lit(1)).alias("total"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / F.lit(most)).cast("bigint")))
    return n.withColumn("part", parts).withColumn("n", F.least(F.lit(most), F.col("total") - F.col("part") * most).cast("bigint")).drop("total")


def effective(df: DataFrame, s: Sequence, paints: Column) -> DataFrame:
    """Drops commands after which the sequence paints nothing."""
    return df.withColumn("dg_paints", F.max(F.when(paints, 1).otherwise(0)).over(s.after())).where("dg_paints = 1").drop("dg_paints")


def with_depth(df: DataFrame, s: Sequence, opens: Column, closes: Column, out: str = "depth") -> DataFrame:
    """Adds the bracket depth after each command."""
    return df.withColumn(out, F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(s.before()).cast("bigint"))


def balanced(df: DataFrame, s: Sequence, opens: Column, closes: Column) -> DataFrame:
    """For each sequence the least and last depth, and whether brackets match."""
    deep = with_depth(df, s, opens, closes)
    ends = F.max_by("depth", F.struct(*s.order))
    return deep.groupBy(s.key).agg(F.min("depth").alias("low"), ends.alias("last")).withColumn("balanced", (F.col("low") >= 0) & (F.col("last") == 0))


def matching_open(df: DataFrame, s: Sequence, opens: Column, closes: Column, row: str) -> DataFrame:
    """For each closing command the row of the opening one it matches, null if there is none.

    An opening command that lifts the depth to d matches the next closing one that lowers it to d - 1; so at each level the
    last opening row is the one.
    """
    deep = with_depth(df, s, opens, closes)
    marked = deep.withColumn("dg_open", opens).withColumn("dg_close", closes).withColumn("dg_level", F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1))
    level = Window.partitionBy(s.key, "dg_level").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, -1)
    brackets = marked.where("dg_open or dg_close")
    before = brackets.withColumn("dg_row", F.last(F.when(F.col("dg_open"), F.col(row))).over(level)).withColumn("dg_was_open", F.last("dg_open").over(level))
    return before.where("dg_close").withColumn("open_row", F.when(F.col("dg_was_open"), F.col("dg_row"))).drop("dg_open", "dg_close", "dg_level", "dg_row", "dg_was_open")


def canonical_order(df: DataFrame, s: Sequence, weight: Column, out: str = "place") -> DataFrame:
    """Adds each command's place when runs of weighted commands are sorted by weight, stable; others stay and part runs."""
    w = df.withColumn("dg_weight", weight)
    bounds = F.sum(F.when(F.col("dg_weight").isNull(), 1).otherwise(0)).over(s.before())
    run = w.withColumn("dg_run", bounds)
    order = Window.partitionBy(s.key).orderBy("dg_run", F.col("dg_weight").asc_nulls_first(), *s.order)
    return run.withColumn(out, (F.row_number().over(order) - 1).cast("bigint")).drop("dg_weight", "dg_run")


def collinear(df: DataFrame, s: Sequence, x: Column, y: Column, out: str = "aligned") -> DataFrame:
    """Adds whether a point lies on the line of its neighbours; ends do not."""
    w = s.window()
    p = df.withColumn("dg_x", x).withColumn("dg_y", y)
    x0, y0, x2, y2 = F.lag("dg_x").over(w), F.lag("dg_y").over(w), F.lead("dg_x").over(w), F.lead("dg_y").over(w)
    cross = (F.col("dg_x") - x0) * (y2 - y0) - (F.col("dg_y") - y0) * (x2 - x0)
    return p.withColumn(out, F.coalesce(cross == 0, F.lit(False))).drop("dg_x", "dg_y")


def rectangles(df: DataFrame, s: Sequence, x: Column, y: Column) -> DataFrame:
    """Rows at which four points in a row are the corners of an axis-aligned rectangle: its corner, width and height."""
    w = s.window()
    p = df.withColumn("dg_x0", x).withColumn("dg_y0", y)
    for k in (1, 2, 3):
        p = p.withColumn(f"dg_x{k}", F.lead("dg_x0", k).over(w)).withColumn(f"dg_y{k}", F.lead("dg_y0", k).over(w))
    c = {k: (F.col(f"dg_x{k}"), F.col(f"dg_y{k}")) for k in range(4)}
    flat_first = (c[0][1] == c[1][1]) & (c[1][0] == c[2][0]) & (c[2][1] == c[3][1]) & (c[3][0] == c[0][0])
    tall_first = (c[0][0] == c[1][0]) & (c[1][1] == c[2][1]) & (c[2][0] == c[3][0]) & (c[3][1] == c[0][1])
    out = p.where(flat_first | tall_first)
    return out.withColumn("width", c[2][0] - c[0][0]).withColumn("height", c[2][1] - c[0][1]).drop(*[f"dg_{a}{k}" for a in "xy" for k in range(4)])
