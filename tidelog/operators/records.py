"""Revisions, ledgers, agreement and down-sampled series over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's last row by `order`: a maximum of structs, so nothing is sorted and partial maxima are shuffled."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, "r.*")


def revised(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Events with the times of `updates` (seq, expected_ts, new_ts) where the expected time still holds.

    A seq with several updates keeps its time, as none of them is the one meant; `state.apply_times`
    refuses such updates as a whole.
    """
    single = updates.groupBy("seq").agg(F.count("*").alias("_n"), F.min("expected_ts").alias("expected_ts"), F.min("new_ts").alias("new_ts")).where("_n = 1").drop("_n")
    joined = events.join(single, "seq", "left")
    hold = F.col("ts").eqNullSafe(F.col("expected_ts")) & F.col("new_ts").isNotNull()
    return joined.select("seq", F.when(hold, F.col("new_ts")).otherwise(F.col("ts")).alias("ts"), F.coalesce(hold, F.lit(False)).alias("changed"))


def ledger(runs: DataFrame, keys: list[str], amount: str, passed: str) -> DataFrame:
    """Sums that are unknown if any part is, an integer median (the middles' mean, rounded down), and a pass rate without inconclusive runs.

    The median comes from running sums over counts of equal amounts, so a key with very
    many runs is never gathered. Keys must not be null.
    """
    out = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.count(amount).alias("known"), F.sum(amount).alias("total"), F.count_if(F.col(passed) == "pass").alias("passes"), F.count_if(F.col(passed).isin("pass", "fail")).alias("judged"))
    counts = runs.where(F.col(amount).isNotNull()).groupBy(*keys, F.col(amount).alias("amount")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    below = counts.withColumn("upto", F.sum("n").over(by.orderBy("amount"))).withColumn("known", F.sum("n").over(by))
    middle = lambda at: F.min(F.when(F.col("upto") > at, F.col("amount")))
    medians = below.groupBy(*keys).agg(F.floor((middle(F.floor((F.col("known") - 1) / 2)) + middle(F.floor(F.col("known") / 2))) / 2).alias("median"))
    return out.join(medians, keys, "left").select(*keys, "runs", F.when(F.col("known") == F.col("runs"), F.col("total")).alias("total"), F.col("median").cast("long").alias("median"), F.round(F.col("passes") / F.nullif(F.col("judged"), F.lit(0)), 6).alias("pass_rate"))


def anchors(claims: DataFrame) -> DataFrame:
    """How many distinct runs and models cite each piece of evidence in each role; independent from two models on."""
    out = claims.groupBy("evidence", "role").agg(F.countDistinct("run").alias("runs"), F.countDistinct("model").alias("models"))
    return out.withColumn("independent", F.col("models") >= 2)


def role_conflicts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("evidence").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.countDistinct("role").alias("n")).where("n > 1").select("evidence", "roles")


def downsampled(points: DataFrame, series: str, width: int) -> DataFrame:
    """Lowest and highest point of each series and bucket of time; of equal ones the earliest."""
    by = points.groupBy(series, F.floor(F.col("ts") / width).alias("bucket"))
    low = F.min(F.struct("value", "ts", "seq"))
    high = F.max(F.struct("value", (-F.col("ts")).alias("before"), (-F.col("seq")).alias("earlier")))
    out = by.agg(low.alias("low"), high.alias("high"))
    return out.select(series, "bucket", F.col("low.seq").alias("low_seq"), F.col("low.value").alias("low"), (-F.col("high.earlier")).alias("high_seq"), F.col("high.value").alias("high"))


def participants(cases: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """Each case with its number of members and the first and last of them; cases without any stay."""
    counted = members.groupBy(key).agg(F.count("*").alias("n"), F.min(member).alias("first"), F.max(member).alias("last"))
    return cases.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "first", "last")
