"""Differences between two states: revisions and their undoing, inventories, plans of what is to be done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undone(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Takes `updates` (seq, expected_ts, new_ts) back where the new time still holds."""
    joined = current.join(updates.select("seq", "expected_ts", "new_ts"), "seq", "left")
    hold = F.col("ts").eqNullSafe(F.col("new_ts")) & F.col("new_ts").isNotNull()
    return joined.select("seq", F.when(hold, F.col("expected_ts")).otherwise(F.col("ts")).alias("ts"))


def revised_stats(events: DataFrame, updates: DataFrame) -> DataFrame:
    """n, first_ts, last_ts after a revision, from the rows it leaves alone and its staged rows."""
    unchanged = events.join(updates.select("seq"), "seq", "left_anti").agg(F.count("ts").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    staged = updates.agg(F.count("new_ts").alias("n"), F.min("new_ts").alias("first_ts"), F.max("new_ts").alias("last_ts"))
    return unchanged.unionByName(staged).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def audited(changes: DataFrame, active: DataFrame, previous: DataFrame, payload: list[str]) -> DataFrame:
    """Changes (seq, old_ts, new_ts) by whether both states bear them out: times as stated, payload equal, nulls included."""
    side = lambda df, name: df.select("seq", *(F.col(c).alias(f"{name}_{c}") for c in ("ts", *payload)))
    joined = changes.join(side(active, "now"), "seq", "left").join(side(previous, "old"), "seq", "left")
    same = F.col("now_ts").eqNullSafe(F.col("new_ts")) & F.col("old_ts").eqNullSafe(F.col("before_ts"))
    for c in payload:
        same = same & F.col(f"now_{c}").eqNullSafe(F.col(f"old_{c}"))
    return joined.select("seq", same.alias("holds"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side beyond their number on the other, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionAll(b.exceptAll(a).withColumn("side", F.lit("b")))


def inventory(before: DataFrame, after: DataFrame, key: str, *marks: str) -> DataFrame:
    """Each key's fate between two inventories: added, removed, changed in one of `marks`, or unchanged."""
    side = lambda df, name: df.select(key, F.struct(*marks).alias(name))
    both = side(before, "a").join(side(after, "b"), key, "full")
    fate = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return both.select(key, fate.alias("fate"))


def to_embed(rows: DataFrame, stored: DataFrame, key: str, content: str, most: int) -> DataFrame:
    """The first `most` rows by key whose content is not stored under their key."""
    return rows.join(stored.select(key, content), [key, content], "left_anti").orderBy(key).limit(most)
