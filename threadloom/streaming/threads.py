"""Structured Streaming forms of counts over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, event_type, events, value: tumbling or sliding windows; works on static and streaming frames."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, session_start, session_end, events."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
