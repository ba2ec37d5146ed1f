"""Templates that may be noise: facts, integer scores, eligibility, shape, and samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import scaled


def facts(events: DataFrame) -> DataFrame:
    """Counts of each template and its minutes; minutes are counted first, so a hot template is summed from them."""
    level = F.lower("level")
    minutes = events.groupBy("template_id", F.floor(F.col("ts") / 60).alias("minute"), "source").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(level.isin("error", "fatal")).alias("errors"),
        F.count_if(level.isin("warn", "warning")).alias("warns"), F.count_if(F.coalesce(level, F.lit("")).isin("info", "")).alias("infos"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "errors", "warns", "infos")]
    by_minute = minutes.groupBy("template_id", "minute").agg(*sums, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    total = by_minute.groupBy("template_id").agg(*sums, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count("*").alias("minutes"), F.max("n").alias("peak"))
    return total.join(minutes.groupBy("template_id").agg(F.countDistinct("source").alias("sources")), "template_id")


def scores(facts_: DataFrame) -> DataFrame:
    """Score of 0 to 100, whether the template may be proposed, and its shape."""
    corpus = F.broadcast(facts_.agg(F.sum("n").alias("all_n"), F.min("first_ts").alias("all_first"), F.max("last_ts").alias("all_last")))
    c = F.col
    f = facts_.crossJoin(corpus)
    share, span, corpus_span = scaled(c("n"), c("all_n")), c("last_ts") - c("first_ts"), c("all_last") - c("all_first")
    volume = F.least(F.lit(40), F.floor(F.least(share, F.lit(1000)) / 25))
    breadth = F.least(c("sources"), F.lit(10)) * 2
    covered, kept = scaled(span, corpus_span, 100), scaled(c("minutes"), F.floor(corpus_span / 60) + 1, 100)
    persistence = (
        F.when((span == 0) | (corpus_span == 0), 0).when((covered >= 70) & (kept >= 20), 15).when(covered >= 70, 12).when((covered >= 40) & (kept >= 10), 9).when(covered >= 40, 7).when(covered >= 20, 4).otherwise(1)
    )
    peak = scaled(c("peak"), c("n"))
    steady = F.when(c("minutes") < 4, 0).when(peak <= 2500, 10).when(peak <= 5000, 6).otherwise(0)
    info, warn = scaled(c("infos"), c("n"), 100), scaled(c("warns"), c("n"), 100)
    stable = F.when(info >= 70, 15).when(warn >= 70, 12).when(info + warn >= 70, 10).otherwise(4)
    raw, errors = volume + breadth + persistence + steady + stable, scaled(c("errors"), c("n"))
    score = F.when(errors >= 5000, F.floor(raw * 50 / 100)).when(errors >= 1000, F.greatest(F.lit(0), raw - 15)).otherwise(raw)
    many = (c("n") >= 10) | ((c("n") >= 5) & (c("sources") >= 3))
    eligible = (c("all_n") >= 20) & many & ((share >= 50) | (c("n") >= 500)) & ~((c("errors") > 0) & (c("n") < 10))
    shape = F.when((span <= 0) | (c("minutes") < 4), "insufficient_time").when(peak <= 2500, "steady").otherwise("bursty")
    return f.select("template_id", "n", share.alias("share_bps"), score.cast("long").alias("score"), eligible.alias("eligible"), shape.alias("shape"))


def level_counts(events: DataFrame, most: int = 16) -> DataFrame:
    """Each template's most frequent levels; the rest count as other."""
    counted = events.groupBy("template_id", "level").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("n"), "level"))
    return counted.withColumn("level", F.when(rank <= most, F.col("level")).otherwise("other")).groupBy("template_id", "level").agg(F.sum("n").alias("n"))


def representatives(events: DataFrame, each: int = 3) -> DataFrame:
    """Sample events of each template, from as many sources as there are.

    A source adds at most its first `each` events; Spark keeps no more of each group
    before the shuffle, so a hot template is not gathered whole.
    """
    by_source = Window.partitionBy("template_id", "source").orderBy("seq")
    ranked = events.select("template_id", "source", "seq").withColumn("source_rank", F.row_number().over(by_source)).where(F.col("source_rank") <= each)
    overall = Window.partitionBy("template_id").orderBy("source_rank", "source", "seq")
    return ranked.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= each).select("template_id", "rank", "source", "seq")
