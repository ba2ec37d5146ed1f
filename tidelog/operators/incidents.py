"""Frequencies, co-occurrence, traces, correlation with a focus, and anomalies between windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERE = ("error", "fatal")


def template_frequency(events: DataFrame) -> DataFrame:
    return events.groupBy("template_id").agg(F.count("*").alias("n"))


def errors_by_service(events: DataFrame) -> DataFrame:
    return events.where(F.col("level").isin(*SEVERE)).groupBy(F.coalesce("service", F.lit("")).alias("service")).agg(F.count("*").alias("n"))


def co_occurrence(events: DataFrame, width: int, top: int) -> DataFrame:
    """Pairs of templates that share time buckets, by the sum of products of their counts. Both sides are counts, not events."""
    counts = events.groupBy(F.floor(F.col("ts") / width).alias("bucket"), "template_id").agg(F.count("*").alias("n"))
    a, b = counts.alias("a"), counts.alias("b")
    pairs = a.join(b, F.expr("a.bucket = b.bucket and a.template_id < b.template_id"))
    found = pairs.groupBy(F.col("a.template_id").alias("template_a"), F.col("b.template_id").alias("template_b")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("n"))
    return found.orderBy(F.desc("n"), "template_a", "template_b").limit(top)


def cross_source_traces(events: DataFrame, top: int = 32) -> DataFrame:
    """Traces seen in more than one source that hold an error."""
    found = events.where("trace_id is not null").groupBy("trace_id").agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(F.col("level").isin(*SEVERE)).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return found.where("sources > 1 and errors > 0").orderBy(F.desc("errors"), F.desc("sources"), F.desc("n"), "trace_id").limit(top)


def follow(events: DataFrame, trace_id: str) -> DataFrame:
    return events.where(F.col("trace_id") == trace_id).select("ts", "seq", "source", "level", F.left("message", F.lit(160)).alias("message"))


def correlate(events: DataFrame, focus_templates: list[int], width: int, top: int) -> DataFrame:
    """Templates near the focus templates' events, and whether they mostly come before them.

    Events, each once, count by second and template first. Nearest is the last focus second at or before,
    or the first after: of the own bucket of the window by running extremes, of the buckets
    beside it their last and first focus second, one row a bucket. No event meets several
    focus seconds; of two equally near the earlier counts.
    """
    is_focus = F.col("template_id").isin(*focus_templates)
    counts = events.where(F.col("ts").isNotNull() & F.col("template_id").isNotNull()).select("seq", "ts", "template_id").distinct().groupBy("ts", "template_id").agg(F.count("*").alias("n"))
    focus = counts.where(is_focus).select("ts").distinct().select("ts", F.floor(F.col("ts") / width).alias("bucket"))
    ends = focus.groupBy("bucket").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    seconds = counts.where(~is_focus).groupBy("ts").agg(F.lit(None).cast("long").alias("focus_ts")).unionByName(focus.select("ts", F.col("ts").alias("focus_ts")))
    seconds = seconds.groupBy("ts").agg(F.max("focus_ts").alias("focus_ts")).withColumn("bucket", F.floor(F.col("ts") / width))
    before, after = (Window.partitionBy("bucket").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("ts"), F.desc("ts")))
    at = seconds.select("ts", "bucket", F.max("focus_ts").over(before).alias("low"), F.min("focus_ts").over(after).alias("high"))
    at = at.join(ends.select((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("earlier")), "bucket", "left").join(ends.select((F.col("bucket") - 1).alias("bucket"), F.col("first").alias("later")), "bucket", "left")
    at = at.select("ts", F.coalesce("low", "earlier").alias("low"), F.coalesce("high", "later").alias("high"))
    is_low = F.col("high").isNull() | (F.col("ts") - F.col("low") <= F.col("high") - F.col("ts"))
    nearest = at.select("ts", F.when(is_low & F.col("low").isNotNull(), F.col("low")).otherwise(F.col("high")).alias("at")).where(F.abs(F.col("ts") - F.col("at")) <= width)
    voted = counts.where(~is_focus).join(nearest, "ts").groupBy("template_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ts") < F.col("at"), F.col("n")).otherwise(-F.col("n"))).alias("votes"))
    scored = voted.select("template_id", "n", (F.col("votes") > 0).alias("precedes"), F.round(F.col("n") * F.when(F.col("votes") > 0, 1.2).otherwise(1.0), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "template_id").limit(top)


def anomalies(events: DataFrame, base: tuple[int, int], incident: tuple[int, int], least: float = 3.0) -> DataFrame:
    """Templates of the incident window that are new or much more frequent than in the base window; both half-open."""
    inside = lambda w: (F.col("ts") >= w[0]) & (F.col("ts") < w[1])
    counts = events.where(inside(base) | inside(incident)).groupBy("template_id").agg(F.count_if(inside(base)).alias("base_n"), F.count_if(inside(incident)).alias("incident_n"))
    score = F.round(F.col("incident_n") / (F.col("base_n") + 1), 6)
    return counts.where("incident_n > 0").withColumn("score", score).where((F.col("base_n") == 0) | (F.col("score") >= least))


def templates_in_range(events: DataFrame, start: int, end: int) -> DataFrame:
    return events.where((F.col("ts") >= start) & (F.col("ts") < end)).select("template_id").distinct()


def scrub(events: DataFrame, cursor: int) -> DataFrame:
    """Each source's first event at or after a time, or else its last one before."""
    at = F.struct("ts", "seq")
    found = events.groupBy("source").agg(F.min(F.when(F.col("ts") >= cursor, at)).alias("next"), F.max(F.when(F.col("ts") < cursor, at)).alias("last"))
    chosen = F.coalesce("next", "last")
    return found.select("source", chosen["ts"].alias("ts"), chosen["seq"].alias("seq"), F.col("next").isNotNull().alias("at_or_after"))


def aligned(events: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of two sources side by side: equal seconds meet occurrence by occurrence."""
    nth = F.row_number().over(Window.partitionBy("source", "ts").orderBy("seq"))
    rows = events.where(F.col("source").isin(left, right)).withColumn("occurrence", nth)
    return rows.groupBy("ts", "occurrence").agg(F.max(F.when(F.col("source") == left, F.col("seq"))).alias("left_seq"), F.max(F.when(F.col("source") == right, F.col("seq"))).alias("right_seq"))


def lane_gaps(events: DataFrame, sources: list[str], width: int) -> DataFrame:
    """Stretches in which some of the sources are silent and others are not: ts_from, ts_to, silent.

    Gaps and islands within a day's buckets, joined over days by a second pass over
    the islands alone, so that no task holds the whole axis.
    """
    rows = events.where(F.col("source").isin(*sources)).select(F.floor(F.col("ts") / width).alias("bucket"), "source").distinct()
    have = rows.groupBy("bucket").agg(F.sort_array(F.collect_set("source")).alias("have"))
    all_ = F.array(*map(F.lit, sorted(sources)))
    silent = have.select("bucket", F.array_join(F.array_except(all_, "have"), ",").alias("silent")).where("silent <> ''")
    chunk = Window.partitionBy("chunk").orderBy("bucket")
    silent = silent.withColumn("chunk", F.floor(F.col("bucket") / 4096))
    new = (F.lag("silent").over(chunk).eqNullSafe(F.col("silent"))) & (F.lag("bucket").over(chunk) == F.col("bucket") - 1)
    part = silent.withColumn("island", F.sum(F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).over(chunk))
    part = part.groupBy("chunk", "island", "silent").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    pattern = Window.partitionBy("silent").orderBy("low")
    joined = part.withColumn("start", F.when(F.lag("high").over(pattern) == F.col("low") - 1, 0).otherwise(1))
    joined = joined.withColumn("run", F.sum("start").over(pattern)).groupBy("silent", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return joined.select((F.col("low") * width).alias("ts_from"), ((F.col("high") + 1) * width).alias("ts_to"), "silent")
