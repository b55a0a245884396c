"""Streaming counterparts of the session aggregates, for logs that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, job_id, n, applies) in tumbling windows; rows later than ``late`` are left out."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), "job_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("action") == "apply").cast("long")).alias("applies")).select(F.col("w.start").alias("start"), "job_id", "n", "applies")


def visits(events: DataFrame, time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(session_id, start, end, n): a user's events with pauses under ``gap``."""
    timed = events.withWatermark(time, late)
    return timed.groupBy("session_id", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
