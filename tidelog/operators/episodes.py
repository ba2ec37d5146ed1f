"""Episodes: runs of events of one lane without a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def episodes(events: DataFrame, lane: list[str], seq_gap: int = 8, wall_gap: int = 5, block: int = 100_000) -> DataFrame:
    """lane columns, episode (from 1), first_seq, last_seq, n of `events` (seq, ts and the lane).

    An event goes on with its lane's episode if it is at most seq_gap events and
    wall_gap seconds behind the one before it. Lanes are worked on in blocks of
    `block` sequence numbers, whose borders are settled on one row a block, so a lane
    with a large part of all rows is shared by many tasks. Events without a seq are
    left out; without a ts, only seq_gap counts. A null lane is a lane.
    """
    rows = events.where("seq is not null").select(*lane, "seq", "ts", F.floor(F.col("seq") / block).alias("block"))
    inside = Window.partitionBy(*lane, "block").orderBy("seq", "ts")
    breaks = lambda before, ts: (F.col("seq") - before > seq_gap) | F.coalesce(F.abs(F.col("ts") - ts) > wall_gap, F.lit(False))
    marked = rows.withColumn("begins", F.coalesce(breaks(F.lag("seq").over(inside), F.lag("ts").over(inside)), F.lit(False)).cast("int"))
    numbered = marked.withColumn("within", F.sum("begins").over(inside))
    # Parts of episodes, at least one a block and lane.
    parts = numbered.groupBy(*lane, "block", "within").agg(F.count("*").alias("n"), F.min(F.struct("seq", "ts")).alias("head"), F.max(F.struct("seq", "ts")).alias("tail"))
    border = parts.groupBy(*lane, "block").agg(F.min(F.struct("head.seq", "head.ts")).alias("head"), F.max("tail").alias("tail"), F.max("within").alias("last"))
    along = Window.partitionBy(*lane).orderBy("block")
    before = F.lag("tail").over(along)
    apart = (F.col("head.seq") - before["seq"] > seq_gap) | F.coalesce(F.abs(F.col("head.ts") - before["ts"]) > wall_gap, F.lit(False))
    border = border.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
    base = border.withColumn("base", F.sum(F.col("opens") + F.col("last")).over(along) - F.col("last")).select(*[F.col(c).alias(f"_{c}") for c in lane], F.col("block").alias("_block"), "base")
    same = F.col("block") == F.col("_block")
    for c in lane:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return parts.join(base, same).groupBy(*lane, (F.col("base") + F.col("within")).alias("episode")).agg(F.min("head.seq").alias("first_seq"), F.max("tail.seq").alias("last_seq"), F.sum("n").alias("n"))
