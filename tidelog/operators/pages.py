"""Keyset pages, neighbourhoods, the source catalogue and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import EventFilter

DIMENSIONS = ("source", "level", "service", "host")


def page(events: DataFrame, wanted: EventFilter, limit: int, after: tuple[int, int] | None = None, before: tuple[int, int] | None = None) -> DataFrame:
    """`limit` rows in order of (ts, seq) after a cursor, or the last ones before one. A top-k per task, no full sort."""
    rows = wanted.apply(events)
    if after:
        rows = rows.where((F.col("ts") > after[0]) | ((F.col("ts") == after[0]) & (F.col("seq") > after[1])))
    if before:
        rows = rows.where((F.col("ts") < before[0]) | ((F.col("ts") == before[0]) & (F.col("seq") < before[1])))
        return rows.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(limit).orderBy("ts", "seq")
    return rows.orderBy("ts", "seq").limit(limit)


def neighbourhood(events: DataFrame, wanted: EventFilter, target: tuple[int, int], radius: int) -> DataFrame:
    """Up to `radius` rows on either side of the row at (ts, seq), itself included where the filter shows it."""
    own = wanted.apply(events).where((F.col("ts") == target[0]) & (F.col("seq") == target[1]))
    sides = (page(events, wanted, radius, before=target).withColumn("side", F.lit(-1)), own.withColumn("side", F.lit(0)), page(events, wanted, radius, after=target).withColumn("side", F.lit(1)))
    return reduce(DataFrame.unionByName, sides)


def source_catalogue(events: DataFrame, search: str = "", after: str = "", limit: int = 100) -> DataFrame:
    rows = events.where(F.contains(F.lower("source"), F.lit(search.lower())) & (F.col("source") > after))
    return rows.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(limit)


def facets(events: DataFrame, wanted: EventFilter, top: int = 200) -> DataFrame:
    """The most frequent values of each dimension in one scan: dimension, value, n, rank."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in DIMENSIONS)))
    counted = wanted.apply(events).select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= top)


def originals(events: DataFrame, after: int | None, limit: int = 512) -> DataFrame:
    """Events and what they were made from, `limit` at a time by seq behind `after`. No lens hides an original."""
    rows = events if after is None else events.where(F.col("seq") > after)
    return rows.orderBy("seq").limit(limit)
