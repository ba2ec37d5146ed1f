"""Small reports over event tables: ratios, outcomes, totals of pages, leases, rankings of sources, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduction(events: DataFrame, by: str) -> DataFrame:
    """How many events stand for one template, to six places; events without a template count, but make none. A group without templates is null."""
    return events.groupBy(by).agg(F.round(F.count("*") / F.nullif(F.count_distinct("template_id"), F.lit(0)), 6).alias("lines_per_template"))


def confidence(events: DataFrame, by: str, outcome: Column, reason: Column) -> DataFrame:
    """Events by a column, what a parser made of them, and why they have the time they have; nulls are values of their own."""
    return events.groupBy(by, outcome.alias("outcome"), reason.alias("reason")).agg(F.count("*").alias("n"))


def with_total(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows in order, each with the number of all rows; one scan for the page, which Spark cuts in every task, and one for the count."""
    return rows.orderBy(*order).limit(limit).withColumn("total", rows.agg(F.count("*")).scalar())


def stale(leases: DataFrame, is_open: Column, since: str, until: Column, key: str) -> DataFrame:
    """Open leases that were last renewed at `until` or before, the oldest first; one that was never renewed is not stale."""
    return leases.where(is_open & (F.col(since) <= until)).select(key, since).orderBy(since, key)


def ranked_sources(events: DataFrame, is_hit: Column, preferred: list[str], top: int, base: int = 10, more: int = 10, dense: int = 5, share: int = 5) -> DataFrame:
    """The `top` sources by score: `base`, `more` for preferred ones, `dense` where more than one event in `share` is a hit; ties by name."""
    counts = events.groupBy("source").agg(F.count("*").alias("n"), F.count_if(is_hit).alias("hits"))
    first = F.when(F.col("source").isin(*preferred), base + more).otherwise(base) if preferred else F.lit(base)
    return counts.select("source", (first + F.when(F.col("hits") * share > F.col("n"), dense).otherwise(0)).cast("long").alias("score")).orderBy(F.desc("score"), "source").limit(top)


def shared_sources(own: Column, allowed: list[str]) -> Column:
    """The sources of a lane that a view lets in, in order, each once; null for a lane without a list."""
    return F.array_sort(F.array_intersect(own, F.array(*map(F.lit, allowed)).cast("array<string>")))


def uncovered(visible: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """What is visible and cited nowhere. Rows without a key are cited nowhere."""
    return visible.join(cited.select(key), key, "left_anti")


def worth_review(candidates: DataFrame, confidence: int = 70, salience: int = 30) -> DataFrame:
    """Candidates that reach both thresholds (in hundredths); one without either value does not."""
    return candidates.where((F.col("confidence") >= confidence) & (F.col("salience") >= salience))


def in_gaps(ts: Column, gaps: list[tuple[int, int]]) -> Column:
    """Whether a time lies in one of a few gaps, both ends included; null for no time, false without gaps."""
    spans = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in gaps))
    return F.exists(spans, lambda g: ts.between(g["a"], g["b"])) if gaps else F.lit(False)


def clamped(value: Column, least: int, most: int) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), value)))


def parameters(message: Column, pattern: Column) -> Column:
    """The words of a message that stand where its template's pattern has a wildcard, in order; null if they have not as many words."""
    words, tokens = F.split(message, " "), F.split(pattern, " ")
    found = F.transform(F.filter(F.arrays_zip(words.alias("word"), tokens.alias("token")), lambda p: p["token"] == "<*>"), lambda p: p["word"])
    return F.when(F.size(words) == F.size(tokens), found)


def counted_runs(runs: DataFrame, by: str, case: str, model: str, setting: str) -> DataFrame:
    """Distinct cases, models and settings of models, and runs, by a column of a report."""
    return runs.groupBy(by).agg(F.count_distinct(case).alias("cases"), F.count_distinct(model).alias("models"), F.count_distinct(model, setting).alias("pairs"), F.count("*").alias("runs"))
