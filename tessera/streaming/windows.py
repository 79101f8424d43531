"""Event-time windows over streams: counts and sums in tumbling, sliding and session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time_col: str, by: list[str], value_col: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, keys, n and total; in append mode a window comes out once the watermark has passed it."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    grouped = events.withWatermark(time_col, late).groupBy(w.alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value_col).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time_col: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    grouped = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
