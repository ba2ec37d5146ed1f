"""Timelines and first claims over a stream of events; beyond what batch analysis needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_levels(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """Events by window and level; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")


def sessions(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "10 minutes", time: str = "event_time") -> DataFrame:
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_claims(events: DataFrame, keys: list[str], late: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
