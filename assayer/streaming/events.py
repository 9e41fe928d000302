"""Counts of audit-like events in time windows; the same function serves batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n): tumbling counts. A stream drops rows that are later than ``late``; a batch counts all."""
    seen = events.withWatermark(time, late) if events.isStreaming else events
    return seen.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
