"""Evidence by identity: fetching, feeds, claims, traces, telemetry, bookmarks, lanes and logs of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fetched(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose seq is in `ids` (seq); asked twice or unknown, an id gives no more rows."""
    return events.join(ids.select("seq"), "seq", "left_semi")


def delta(rows: DataFrame, at: str, key: str, cursor: int, limit: int = 1000) -> DataFrame:
    """The next rows after a cursor, oldest first, ties by key."""
    return rows.where(F.col(at) > cursor).orderBy(at, key).limit(limit)


def resident(held: DataFrame, page: DataFrame, cap: int) -> DataFrame:
    """The newest `cap` rows of two pages, each (ts, seq) once; where the pages differ, the held row stays."""
    both = held.withColumn("_page", F.lit(0)).unionByName(page.withColumn("_page", F.lit(1)))
    kept = both.groupBy("ts", "seq").agg(F.min_by(F.struct(*held.columns), "_page").alias("r")).select("r.*")
    return kept.orderBy(F.desc("ts"), F.desc("seq")).limit(cap)


def reconciled(claims: DataFrame) -> DataFrame:
    """Claims with the same candidate, kind and set of evidence, and who makes them; agreement needs two models."""
    who = [F.countDistinct(c).alias(f"{c}s") for c in ("role", "model", "gateway")]
    same = claims.groupBy("candidate", "kind", F.array_sort(F.array_distinct("evidence")).alias("evidence"))
    return same.agg(F.count("*").alias("claims"), *who).withColumn("agreed", F.col("models") >= 2)


def compared_traces(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """For each candidate: evidence cited, shared with others, its own alone, and in the gold set."""
    pairs = cited.select("candidate", "evidence").distinct()
    spread = pairs.groupBy("evidence").agg(F.count("*").alias("by")).join(gold.select("evidence").distinct().withColumn("gold", F.lit(1)), "evidence", "left")
    out = pairs.join(spread, "evidence").groupBy("candidate")
    return out.agg(F.count("*").alias("cited"), F.count_if(F.col("by") > 1).alias("shared"), F.count_if(F.col("by") == 1).alias("alone"), F.count("gold").alias("in_gold"))


def telemetry(rounds: DataFrame, key: str, order: str, reported: list[str], present: list[str], outcome: str, last: list[str]) -> DataFrame:
    """One row a turn: sums that are unknown if a round's part is, sums of what is known, and the last completed round's values."""
    whole = [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in reported]
    known = [F.sum(c).alias(c) for c in present]
    final = F.max(F.when(F.col(outcome) == "completed", F.struct(order, *last)))
    return rounds.groupBy(key).agg(F.count("*").alias("rounds"), *whole, *known, final.alias("_f")).select(key, "rounds", *reported, *present, *[F.col(f"_f.{c}").alias(c) for c in last])


def resolved(references: DataFrame, events: DataFrame) -> DataFrame:
    """Bookmarks over references (bookmark, seq, expected_ts): valid if every event is there as it was.

    Repeated references go in tasks of their own, as many as the session shuffles into. Behind a join by seq they would
    go in the join's tasks, which Spark merges by their bytes, and all of their sets would be held there at once.
    """
    there = events.select("seq", "ts", F.lit(True).alias("_there"))
    state = F.col("_there").isNotNull() & F.col("ts").eqNullSafe(F.col("expected_ts"))
    keys, parts = ["bookmark", "seq", "expected_ts"], int(references.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = references.repartition(parts, *keys).dropDuplicates(keys).join(there, "seq", "left").withColumn("_ok", state)
    out = joined.groupBy("bookmark").agg(F.count("*").alias("n_refs"), F.count_if(F.col("_there").isNull()).alias("missing"), F.count_if("_ok").alias("valid"))
    return out.withColumn("status", F.when(F.col("valid") == F.col("n_refs"), "valid").otherwise("stale"))


def written(log: DataFrame, key: str, order: str, value: str, deed: str) -> DataFrame:
    """What a log of write, retract and purge leaves of each record: its last state, a tombstone without value once purged.

    A purge holds for good; later writes do not bring a record back.
    """
    last = F.max(F.struct(order, F.col(deed).alias("deed"), F.col(value).alias("value")))
    out = log.groupBy(key).agg(F.max(F.col(deed) == "purge").alias("purged"), last.alias("l"), F.count("*").alias("revisions"))
    status = F.when(F.col("purged"), "purged").when(F.col("l.deed") == "retract", "retracted").otherwise("active")
    return out.select(key, "revisions", status.alias("status"), F.when(status == "active", F.col("l.value")).alias("value"))


def lanes(evidence: DataFrame, group: Column, order: str, limit: int = 4) -> DataFrame:
    """group, n and lane (from 1) of each group by first appearance; groups beyond `limit` have no lane."""
    groups = evidence.groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = groups.orderBy("first", "group").limit(limit).agg(F.array_sort(F.collect_list(F.struct("first", "group"))).alias("l")).select(F.posexplode("l").alias("at", "g"))
    named = F.broadcast(top.select((F.col("at") + 1).alias("lane"), F.col("g.group").alias("_group")))  # at most `limit` rows
    return groups.join(named, F.col("group").eqNullSafe(F.col("_group")), "left").select("group", "n", "lane")


def accepted(candidates: DataFrame, hosts: DataFrame, key: str) -> DataFrame:
    """Each distinct candidate id, and whether the host set has it."""
    known = hosts.select(key).distinct().withColumn("_known", F.lit(True))
    return candidates.select(key).distinct().join(known, key, "left").select(key, F.coalesce("_known", F.lit(False)).alias("accepted"))
