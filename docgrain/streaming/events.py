"""Ordered rewrites on unbounded input, with Structured Streaming. The batch operators give the same rows on the whole input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_changes(events: DataFrame, key: str = "user_id", value: str = "event_type", order: str = "event_id") -> DataFrame:
    """Events that change their key's value, and each key's first. Micro-batches must come in order; inside one, rows are ordered here.

    The state is one value a key.
    """
    schema = f"{key} long, {order} long, {value} string"

    def run(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        before = rows[value].shift(1, fill_value="" if last is None else last)
        new = rows[value] != before
        if last is None and len(new):
            new.iloc[0] = True
        state.update((rows[value].iloc[-1],))
        yield rows.loc[new, [key, order, value]]

    grouped = events.select(key, order, value).groupBy(key)
    return grouped.applyInPandasWithState(run, outputStructType=schema, stateStructType="last string", outputMode="append", timeoutConf="NoTimeout")


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by kind in windows; rows that come later than `late` behind the newest are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def distinct_within(events: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first event of each key inside the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
