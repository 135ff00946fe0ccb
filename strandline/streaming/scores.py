"""Scores as a stream: windowed and session aggregates with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(scores: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and mean value of each metric in each window; works on a batch and on a stream."""
    rows = scores.withWatermark(time, late) if scores.isStreaming else scores
    return rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(scores: DataFrame, time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: rows of a user with pauses shorter than the gap."""
    rows = scores.withWatermark(time, late) if scores.isStreaming else scores
    return rows.groupBy(F.session_window(time, gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
