"""Windowed counts of events, the same on a table and on a stream (an extension beyond the stored graph)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Events with ``ts`` as a timestamp, which watermarks need; the session's zone must be UTC."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return e.withWatermark("ts", late) if late and e.isStreaming else e


def tumbling(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """(event_type, window_start, n, total) of windows of one length that follow each other; events later than ``late`` are dropped from streams."""
    w = F.window("ts", length)
    n = _timed(events, late).groupBy("event_type", w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return n.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): sessions of each user, which end when ``gap`` passes without an event."""
    n = _timed(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n")
