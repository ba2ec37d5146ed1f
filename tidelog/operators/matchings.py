"""Pairs that every largest matching holds, in a graph too large for one task, by rounds over tables.

Every step is a join, a grouping or a distinct over pairs and sides, so no task holds a
component, and a side with many pairs is shared out like any other key. The number of rounds
grows with the length of the shortest paths between sides, not with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import fresh_folder, kept

_SEEN = "right long, left long, root long, next long"


def _as(table: DataFrame, **names: str) -> DataFrame:
    return table.select(*(F.col(old).alias(new) for new, old in names.items()))


def _first_free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each left side of a sorted partition with its first right side that none before it has."""
    used, last = set(), None
    for batch in batches:
        found = []
        for left, right in zip(batch["left"].tolist(), batch["right"].tolist(), strict=True):
            if left != last and right not in used:
                used.add(right)
                found.append((left, right))
                last = left
        yield pd.DataFrame(found, columns=["left", "right"])


def _searched(edges: DataFrame, free: DataFrame, match: DataFrame, path: str, n: int) -> DataFrame:
    """The right sides reached from free left sides, each once: right, the left side before it, the root of its tree, next (its partner). A tree that has met a free right side grows no further."""
    spark = edges.sparkSession
    front, seen = _as(free, left="left", root="left"), spark.createDataFrame([], _SEEN)
    for k in count():
        reach = edges.join(front, "left").join(seen.select("right"), "right", "left_anti")
        one = reach.groupBy("right").agg(F.min_by(F.struct("left", "root"), F.xxhash64("left", "right", F.lit(n))).alias("s"))
        new = kept(one.select("right", "s.left", "s.root").join(_as(match, right="right", next="left"), "right", "left"), f"{path}/k={k}")
        seen = spark.read.schema(_SEEN).parquet(path).select("right", "left", "root", "next")
        if new.isEmpty():
            return seen
        front = _as(new.where("next is not null").join(seen.where("next is null").select("root").distinct(), "root", "left_anti"), left="next", root="root")


def _flipped(seen: DataFrame, match: DataFrame, path: str) -> DataFrame:
    """`match` with one path of each tree that met a free right side flipped; trees share no side."""
    back = seen.select("right", "left")
    now = seen.where("next is null").groupBy("root").agg(F.min("right").alias("right")).join(back, "right").select("left", "right", "root")
    for k in count():
        now = kept(now, f"{path}/k={k}")
        if now.isEmpty():
            break
        now = now.where("left <> root").join(_as(match, left="left", old="right"), "left").select("root", F.col("old").alias("right")).join(back, "right").select("left", "right", "root")
    flips = seen.sparkSession.read.schema("left long, right long, root long").parquet(path).select("left", "right")
    return match.join(flips, "left", "left_anti").unionByName(flips)


def _largest(edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """A matching of the largest size (left, right), and the left sides reached from free ones."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begun = edges.repartitionByRange(parts, "left").sortWithinPartitions("left", "right").mapInPandas(_first_free, "left long, right long")
    match = kept(begun.groupBy("right").agg(F.min("left").alias("left")).select("left", "right"), f"{path}/match")
    lefts = kept(edges.select("left").distinct(), f"{path}/lefts")
    for n in count():
        free = kept(lefts.join(match, "left", "left_anti"), f"{path}/free{n}")
        seen = _searched(edges, free, match, f"{path}/seen{n}", n)
        if seen.where("next is null").isEmpty():
            return match, free.unionByName(_as(seen, left="next"))
        match = kept(_flipped(seen, match, f"{path}/flips{n}"), f"{path}/match{n}")


def _reached(begin: DataFrame, arcs: DataFrame, path: str) -> DataFrame:
    """The nodes reached from some nodes over arcs (u, v), these included."""
    spark, new = begin.sparkSession, begin.select(F.col("node").cast("long")).distinct()
    for k in count():
        new = kept(new, f"{path}/k={k}")
        seen = spark.read.schema("node long").parquet(path).select("node")
        if new.isEmpty():
            return seen
        new = _as(arcs.join(_as(new, u="node"), "u"), node="v").distinct().join(seen, "node", "left_anti")


def _trimmed(arcs: DataFrame, path: str) -> DataFrame:
    """Arcs between nodes that have arcs both in and out, over and over."""
    size = arcs.count()
    for k in count():
        arcs = kept(arcs.join(_as(arcs, u="v").distinct(), "u", "left_semi").join(_as(arcs, v="u").distinct(), "v", "left_semi").select("u", "v"), f"{path}/{k}")
        before, size = size, arcs.count()
        if size == before:
            return arcs


def _coloured(arcs: DataFrame, path: str) -> DataFrame:
    """node, colour: the greatest node from which it can be reached."""
    colours = kept(_as(arcs, node="u").unionByName(_as(arcs, node="v")).distinct().withColumn("colour", F.col("node")).withColumn("new", F.lit(True)), f"{path}/0")
    for k in count(1):
        told = arcs.join(_as(colours.where("new"), u="node", colour="colour"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("told"))
        better = F.coalesce(F.col("told") > F.col("colour"), F.lit(False))
        colours = kept(colours.join(told, "node", "left").select("node", F.greatest("colour", "told").alias("colour"), better.alias("new")), f"{path}/{k}")
        if colours.where("new").isEmpty():
            return colours.select("node", "colour")


def on_rings(arcs: DataFrame) -> DataFrame:
    """The nodes (node) that lie on a ring of arcs (u, v).

    Colours run down the arcs; what has the colour of a node and leads to it, lies on a ring with it. These go, and the rest is coloured again.
    """
    spark, root = arcs.sparkSession, fresh_folder(arcs.sparkSession, "rings")
    kept(spark.createDataFrame([], "node long"), f"{root}/found/n=none")
    for n in count():
        path = f"{root}/{n}"
        arcs = _trimmed(arcs, f"{path}/trimmed")
        if arcs.isEmpty():
            return spark.read.schema("node long").parquet(f"{root}/found").select("node")
        colours = _coloured(arcs, f"{path}/colours")
        coloured = arcs.join(_as(colours, u="node", colour="colour"), "u").join(_as(colours, v="node", other="colour"), "v")
        alike = kept(coloured.where("colour = other").select("u", "v", "colour"), f"{path}/alike")
        back = _reached(_as(colours.where("node = colour"), node="node"), _as(alike, u="v", v="u"), f"{path}/back")
        groups = colours.join(back, "node")
        kept(groups.join(groups.groupBy("colour").agg(F.count("*").alias("size")).where("size > 1"), "colour").select("node"), f"{root}/found/n={n}")
        arcs = kept(alike.join(_as(back, u="node"), "u", "left_anti").join(_as(back, v="node"), "v", "left_anti").select("u", "v"), f"{path}/rest")


def sure(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct pairs (left, right): a matching of the largest size without the pairs that lie on a path to a free side, and the arcs (u, v) from left sides to the partners of their other right sides, among them. What lies on a ring of arcs is not sure either."""
    path = fresh_folder(edges.sparkSession, "largest")
    match, from_free = _largest(edges, path)
    owner = _as(match, right="right", v="left")
    arcs = kept(edges.join(owner, "right").where("left <> v").select(F.col("left").alias("u"), "v"), f"{path}/arcs")
    ends = edges.join(match.select("right"), "right", "left_anti").select(F.col("left").alias("node"))
    to_free = _reached(ends, _as(arcs, u="v", v="u"), f"{path}/back")
    core = kept(match.join(from_free.distinct(), "left", "left_anti").join(_as(to_free, left="node"), "left", "left_anti").select("left", "right"), f"{path}/core")
    inner = arcs.join(_as(core, u="left"), "u", "left_semi").join(_as(core, v="left"), "v", "left_semi").select("u", "v")
    return core, kept(inner, f"{path}/inner")


def settled(edges: DataFrame) -> DataFrame:
    """Distinct pairs (left, right) with their status, as `graphs.matched` says."""
    core, arcs = sure(edges)
    held = core.join(_as(on_rings(arcs), left="node"), "left", "left_anti")
    lefts, rights = _as(held, left="left", with_right="right"), _as(held, right="right", with_left="left")
    status = F.when(F.col("with_right") == F.col("right"), "paired").when(F.coalesce("with_right", "with_left").isNotNull(), "ruled_out").otherwise("ambiguous")
    return edges.join(lefts, "left", "left").join(rights, "right", "left").select("left", "right", status.alias("status"))
