"""Counts of events per user and window, over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_counts(events: DataFrame, seconds: int = 10, late: str = "1 minute", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Events per user and tumbling window; on a stream late events are waited for as long as `late` says."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), F.col(user)).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("window_start"), user, "requests")
