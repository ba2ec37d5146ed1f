"""Timelines: fixed, coarsened, bounded, and dense over several lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels

MAX_BUCKETS = 512


def fixed(events: DataFrame, width: int) -> DataFrame:
    return events.groupBy((F.floor(F.col("ts") / width) * width).alias("bucket"), "level").agg(F.count("*").alias("n"))


def _bounds(events: DataFrame) -> DataFrame:
    """One row; small enough to broadcast whatever the input."""
    return F.broadcast(events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("ts").alias("total")))


def _width(most: int) -> Column:
    span = F.greatest(F.lit(1), F.col("high") - F.col("low") + 1)
    return F.floor((span + most - 1) / most).cast("long")


def bounded(events: DataFrame, most: int = 96) -> DataFrame:
    """At most `most` buckets over the whole span, sparse: bucket, start, end, level, n, width."""
    rows = events.where("ts is not null").crossJoin(_bounds(events).withColumn("width", _width(most)))
    rows = rows.withColumn("bucket", F.floor((F.col("ts") - F.col("low")) / F.col("width")))
    counted = rows.groupBy("bucket", "level", "low", "high", "width").agg(F.count("*").alias("n"))
    start = F.col("low") + F.col("bucket") * F.col("width")
    return counted.select("bucket", start.alias("start"), F.least(start + F.col("width"), F.col("high") + 1).alias("end"), "level", "n", "width")


def coarsened(events: DataFrame, widths: tuple[int, ...] = (1, 5, 15, 60, 300, 900, 3600, 21_600, 86_400, 604_800, 2_592_000)) -> DataFrame:
    """The smallest of `widths` that needs at most MAX_BUCKETS: start, level, n, width."""
    fits = F.coalesce(*(F.when(F.floor(F.col("high") / w) - F.floor(F.col("low") / w) + 1 <= MAX_BUCKETS, F.lit(w)) for w in widths), F.lit(widths[-1]))
    rows = events.where("ts is not null").crossJoin(_bounds(events).select(fits.cast("long").alias("width")))
    return rows.groupBy((F.col("ts") - F.col("ts") % F.col("width")).alias("start"), "level", "width").agg(F.count("*").alias("n"))


def dense_lanes(events: DataFrame, lanes: dict[str, list[str]], most: int = 48) -> DataFrame:
    """One axis for all lanes (lists of sources), every cell present: lane, series, counts."""
    chosen = F.coalesce(*(F.when(F.col("source").isin(*s), F.lit(n)) for n, s in lanes.items()))
    laned = events.withColumn("lane", chosen).where("lane is not null and ts is not null")
    frame = _bounds(laned).withColumn("width", _width(most))
    rows = laned.crossJoin(frame).withColumn("bucket", F.floor((F.col("ts") - F.col("low")) / F.col("width")).cast("int"))
    counted = rows.groupBy("lane", levels.band(F.col("level")).alias("series"), "bucket").agg(F.count("*").alias("n"))
    filled = counted.groupBy("lane", "series").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("at"))
    names = F.array(*(F.lit(n) for n in lanes))
    grid = frame.select(F.explode(names).alias("lane"), "low", "high", "width").select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("series"))
    last = F.floor((F.col("high") - F.col("low")) / F.col("width")).cast("int")
    zero = F.lit(0).cast("long")
    counts = F.transform(F.sequence(F.lit(0), last), lambda b: F.coalesce(F.try_element_at("at", b), zero))
    return grid.join(filled, ["lane", "series"], "left").where("low is not null").select("lane", F.array(*map(F.lit, levels.SERIES))[F.col("series")].alias("series"), counts.alias("counts"))
