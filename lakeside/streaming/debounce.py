"""Bursts of events as one: a batch of events ends when none follows within the gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str = "ts", gap: str = "1500 milliseconds", late: str | None = None) -> DataFrame:
    """key, began, last, n of every burst; each event puts its end off by the gap.  Works on tables and, with ``late`` as its
    watermark, on streams."""
    if late is not None:
        events = events.withWatermark(ts, late)
    burst = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    return burst.select(key, F.col("w.start").alias("began"), "last", "n")
