"""Connected components of an edge table, without bringing links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Links that one task settles at a time.
AT_ONCE = 1 << 19
#: Links between parts that one task may settle alone; beyond that they go through shuffled rounds.
ALONE = 100_000


def settle(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each AT_ONCE links of a partition, with the smallest node that those links reach."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out() -> pa.RecordBatch:
        ends = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)]
        node, place = np.unique(np.concatenate(ends), return_inverse=True)
        place = place.ravel()
        root = settle(len(node), place[: len(ends[0])], place[len(ends[0]) :])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "root"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step of large-star or small-star; edges have u > v, each once.

    Every node's neighbours are hung on the smallest of them (or the node). The
    minimum is a plain aggregate and the re-hanging a join, so a node with very
    many neighbours is never gathered in one place.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return hung.where("u <> v").distinct()


def _rounds(now: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) by large-star and small-star in turn, until the edges rest."""
    seen, step = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, step = mark, step + 1
        now = scratch.keep(_star(_star(now, True), False), f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) once for each node with a link; root is the smallest node it reaches.

    `edges` has integer columns a and b. Nulls and self-links are ignored. Each task
    first settles its own links. Where the tasks disagree on a node, their roots are
    linked in turn; of these few links, up to ALONE are settled by one task, more of
    them by shuffled rounds, whose number grows with the logarithm of the longest chain.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    local = scratch.keep(links.mapInArrow(_forest, "node long, root long"), f"{name}-local")
    nodes = scratch.keep(local.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")), f"{name}-nodes")
    torn = nodes.where("low <> high").select("node", "low")
    met = scratch.keep(local.join(torn, "node").where("root <> low").select(F.col("root").alias("u"), F.col("low").alias("v")).distinct(), f"{name}-met")
    n = met.count()
    if not n:
        return nodes.select("node", F.col("low").alias("root"))
    top = met.coalesce(1).mapInArrow(_forest, "node long, root long") if n <= ALONE else _rounds(met, scratch, f"{name}-star")
    top = scratch.keep(top, f"{name}-top").withColumnsRenamed({"node": "low", "root": "top"})
    return nodes.join(top, "low", "left").select("node", F.coalesce("top", "low").alias("root"))
