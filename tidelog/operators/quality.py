"""Quality of a log corpus: aggregates, concentration, weighted dimensions and a grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import scaled

# Weights in basis points, and the least score of each grade.
WEIGHTS = {"timestamp_certainty": 2500, "selection_coverage": 1500, "parse_structure": 1500, "stored_level_usefulness": 1500, "noise_concentration_review": 1500, "trace_id_coverage": 1500}
GRADES = (("A", 85), ("B", 70), ("C", 50), ("D", 25))


def by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(
        F.count("*").alias("n"), F.count("ts").alias("wall"), F.count("trace_id").alias("traced"), F.count_if(F.coalesce("level", F.lit("unknown")) == "unknown").alias("unknown_level"), F.countDistinct("template_id").alias("templates")
    )


def concentration(events: DataFrame) -> DataFrame:
    """Share of the most frequent template and the sum of squared shares, in integers."""
    counts = events.groupBy("template_id").agg(F.count("*").alias("n"))
    share = scaled(F.col("n"), F.col("total"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("n", share.alias("share"), "total")
    return shares.agg(F.coalesce(F.max("share"), F.lit(0)).alias("top_share_bps"), F.least(F.floor(F.coalesce(F.sum(F.col("share") * F.col("share")), F.lit(0)) / 100), F.lit(10_000)).alias("hhi_bps"), F.coalesce(F.max("total"), F.lit(0)).alias("n"))


def grade(events: DataFrame, structured: Column, sources: DataFrame) -> DataFrame:
    """One row: the score of each dimension, their weighted mean and its grade.

    `structured` tells which events a grammar could read; `sources` has source and
    selected for all that were found, so what was left out counts as not covered.
    """
    found = F.broadcast(sources.agg(F.count("*").alias("sources"), F.count_if("selected").alias("selected")))  # one row
    total = events.agg(F.count_if(structured).alias("structured"), F.count("*").alias("n"), F.count("ts").alias("wall"), F.count("trace_id").alias("traced"), F.count_if(F.coalesce("level", F.lit("unknown")) != "unknown").alias("known"))
    one = total.crossJoin(concentration(events).drop("n")).crossJoin(found)
    top, hhi = F.col("top_share_bps"), F.col("hhi_bps")
    percent = lambda c: F.floor(scaled(F.col(c), F.col("n")) / 100)
    crowded = F.when(top >= 5000, 35).when(top >= 2500, 15).otherwise(0) + F.when(hhi >= 4000, 20).otherwise(0)
    scores = {
        "timestamp_certainty": percent("wall"), "selection_coverage": F.floor(scaled(F.col("selected"), F.col("sources")) / 100), "parse_structure": percent("structured"), "stored_level_usefulness": percent("known"), "noise_concentration_review": 80 - crowded, "trace_id_coverage": percent("traced"),
    }
    mean = sum(scores[d] * w for d, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    one = one.select(*(s.cast("long").alias(d) for d, s in scores.items()), F.floor(mean).cast("long").alias("score"))
    letter = F.lit("F")
    for name, least in reversed(GRADES):
        letter = F.when(F.col("score") >= least, name).otherwise(letter)
    return one.withColumn("grade", letter)


def findings(events: DataFrame, basis: Column, structured: Column, sources: DataFrame, most: int = 24) -> DataFrame:
    """What is to be improved, most urgent first: id, severity, priority, and the measured number behind it.

    `basis` is wall, unresolved or order for each event; `sources` has source and state
    (imported, failed, ignored, unsupported, partial) for all that were found. Every rule
    is a row over one pass of counts, so nothing but counts leaves the executors.
    """
    rows = events.withColumn("_basis", basis)
    on = lambda name: F.count_if(F.col("_basis") == name)
    totals = rows.agg(F.count("*").alias("n"), on("wall").alias("wall"), on("unresolved").alias("unresolved"), F.count_if(~structured).alias("plain"), F.count("trace_id").alias("traced"), F.count_if(F.coalesce("level", F.lit("unknown")) != "unknown").alias("known"))
    states = sources.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("failed", "ignored", "unsupported", "partial")))
    weak = rows.groupBy("source").agg(scaled(on("wall"), F.count("*")).alias("share"), F.count("*").alias("n")).where("n >= 2 and share < 5000").agg(F.count("*").alias("weak"))
    one = totals.crossJoin(states).crossJoin(concentration(events).select("top_share_bps")).crossJoin(weak)  # one row each
    n, share = F.col("n"), (lambda c: scaled(F.col(c), F.col("n")))
    order = scaled(n - F.col("wall") - F.col("unresolved"), n)
    some, top = n > 0, F.col("top_share_bps")
    level = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    # The rules, their priorities and thresholds in basis points.
    rules = (
        ("lq.corpus.empty", n == 0, F.lit("critical"), F.lit(100), n),
        ("lq.timestamp.order_only_dominant", some & (order >= 8000), F.lit("critical"), F.lit(95), order),
        ("lq.timestamp.mixed_certainty", some & (order < 8000) & ((order >= 2000) | ((F.col("wall") > 0) & (F.col("wall") < n))), F.lit("high"), F.lit(85), order),
        ("lq.timestamp.unresolved_local_share", some & (share("unresolved") >= 500), level(share("unresolved") >= 2500, "high", "medium"), F.lit(80), share("unresolved")),
        ("lq.selection.failed_sources", some & (F.col("failed") > 0), F.lit("high"), F.lit(78), F.col("failed")),
        ("lq.selection.partial_import", some & (F.col("partial") > 0), F.lit("high"), F.lit(76), F.col("partial")),
        ("lq.severity.stored_level_not_provenance", some, level(share("known") < 7000, "high", "info"), level(share("known") < 7000, 72, 35), share("known")),
        ("lq.noise.review_only_concentration", (n >= 20) & (top >= 2500), level(top >= 5000, "high", "medium"), F.lit(70), top),
        ("lq.timestamp.source_weak_certainty", some & (F.col("weak") > 0), F.lit("medium"), F.lit(65), F.col("weak")),
        ("lq.trace.low_parser_trace_id_coverage", (n >= 10) & (share("traced") < 2000), F.lit("medium"), F.lit(60), share("traced")),
        ("lq.parse.mostly_plain", some & (share("plain") >= 6000), F.lit("medium"), F.lit(55), share("plain")),
        ("lq.selection.coverage_buckets", some & (F.col("ignored") + F.col("unsupported") > 0), F.lit("info"), F.lit(40), F.col("ignored") + F.col("unsupported")),
    )
    made = F.array(*(F.when(holds, F.struct(F.lit(name).alias("id"), severity.alias("severity"), priority.cast("int").alias("priority"), measured.cast("long").alias("measured"))) for name, holds, severity, priority, measured in rules))
    return one.select(F.explode(F.array_compact(made)).alias("f")).select("f.*").orderBy(F.desc("priority"), "id").limit(most)
