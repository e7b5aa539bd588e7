"""An extra beyond the batch engine: arcs between successive users, by event-time window, from a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``[start, src, dst, weight]``: users to event types by tumbling window; on a stream, late events count up to the watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size).alias("w"), F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return g.select(F.col("w.start").alias("start"), "src", "dst", "weight")
