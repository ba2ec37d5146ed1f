"""Facts about templates, sources and series of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def template_facts(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts and times of the candidates' events, all by conditional aggregates of one pass."""
    bad = F.col("level").isin("error", "fatal")
    return events.join(candidates.select("template_id").distinct(), "template_id").groupBy("template_id").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count("trace_id").alias("traced"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min(F.when(bad, F.col("ts"))).alias("first_error_ts"), F.max(F.when(bad, F.col("ts"))).alias("last_error_ts"), F.countDistinct("source").alias("sources"),
    )


def suppression_preview(events: DataFrame, template_ids: list[int], representatives: int = 3) -> DataFrame:
    """What each template's suppression would hide: counts, times, levels, and its first few events."""
    rows = events.where(F.col("template_id").isin(*template_ids))
    facts = rows.groupBy("template_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    levels = rows.groupBy("template_id", "level").agg(F.count("*").alias("n")).groupBy("template_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "n"))), lambda x: F.concat_ws(":", x["level"], x["n"].cast("string"))), ",").alias("levels"))
    place = F.row_number().over(Window.partitionBy("template_id").orderBy("ts", "seq"))
    first = rows.withColumn("place", place).where(F.col("place") <= representatives)
    first = first.groupBy("template_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "seq"))), lambda x: x["seq"].cast("string")), ",").alias("shown"))
    return facts.join(levels, "template_id").join(first, "template_id")


def steps_back(points: DataFrame, series: str) -> DataFrame:
    """How many points of each series do not come after the one before it in seq. Blocks of seq share a series; borders are settled on one row a block."""
    rows = points.select(series, "seq", "ts", F.floor(F.col("seq") / 100_000).alias("block"))
    inside = Window.partitionBy(series, "block").orderBy("seq")
    marked = rows.withColumn("back", F.coalesce((F.lag("ts").over(inside) >= F.col("ts")).cast("int"), F.lit(0)))
    blocks = marked.groupBy(series, "block").agg(F.sum("back").alias("back"), F.min(F.struct("seq", "ts")).alias("head"), F.max(F.struct("seq", "ts")).alias("tail"))
    border = (F.lag("tail").over(Window.partitionBy(series).orderBy("block"))["ts"] >= F.col("head.ts")).cast("int")
    return blocks.withColumn("border", F.coalesce(border, F.lit(0))).groupBy(series).agg(F.sum(F.col("back") + F.col("border")).alias("back"))


def in_range(points: DataFrame, series: str, start: int, end: int) -> DataFrame:
    """Points of each series between two times, with the one before and the one after. The neighbours are a maximum and a minimum, so no series is sorted."""
    at = F.struct("ts", "seq")
    edges = points.groupBy(series).agg(F.max(F.when(F.col("ts") < start, at)).alias("before"), F.min(F.when(F.col("ts") > end, at)).alias("after"))
    beside = edges.select(series, F.explode(F.array_compact(F.array("before", "after"))).alias("p")).select(series, "p.ts", "p.seq", F.lit(True).alias("neighbour"))
    return points.where(F.col("ts").between(start, end)).select(series, "ts", "seq", F.lit(False).alias("neighbour")).unionByName(beside)


def lane_quality(lanes: DataFrame, loaded: DataFrame) -> DataFrame:
    """The least reliable time quality of each view's lanes; a lane that is not loaded has order only."""
    rank = F.when(F.col("quality") == "wall", 0).when(F.col("quality") == "mixed", 1).otherwise(2)
    worst = lanes.join(loaded, "lane", "left").groupBy("view").agg(F.max(rank).alias("rank"))
    return worst.select("view", F.element_at(F.array(*map(F.lit, ("wall", "mixed", "order_only"))), F.col("rank") + 1).alias("quality"))


def due(watchers: DataFrame, runs: DataFrame, now: int, least: int = 60) -> DataFrame:
    """Enabled watchers that are due: never run, or longer ago than their interval and a jitter that their id fixes.

    The jitter is the number in the first eight bytes, lowest first, of the sha256 of the id as
    text, modulo a tenth of the interval (1 to 60 seconds) and one.
    `watchers` has id, enabled and every (seconds, at least `least`), `runs` id and last_ts.
    """
    every = F.greatest(F.col("every"), F.lit(least))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    octets = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)))
    window = F.least(F.greatest(F.floor(every / 10), F.lit(1)), F.lit(60)).cast("long") + 1
    half = lambda at: F.conv(F.substring(octets, at, 8), 16, 10).cast("long")
    jitter = ((half(1) % window) * ((F.lit(1 << 32) % window)) + half(9)) % window
    joined = watchers.where("enabled").join(runs, "id", "left")
    return joined.where(F.col("last_ts").isNull() | (F.lit(now) - F.col("last_ts") >= every + jitter)).select("id", "last_ts", jitter.alias("jitter"))
