"""Approximate nearest vectors by graphs: a navigable graph of neighbours for each shard, searched by a beam.

Shards are of bounded size, so a graph is built by one task from exact neighbours in its shard;
queries visit every shard and their best are merged. Below EXACT vectors `nearest` scans exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import fresh_folder, kept
from .retrieval import nearest_vectors

# Fixed value: the number of vectors from which the graph is taken.
EXACT = 50_000
SHARD_ROWS, DEGREE, BEAM = 8_192, 32, 128
#: Queries that walk a shard's graph together, and vectors that meet all of their shard at a time when it is built.
TOGETHER, BLOCK = 512, 256


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of unit vectors, rows by `degree`: half the nearest that are not nearer to an earlier pick, the rest nodes that picked this one, then a ring over all, so that every node is reached."""
    n = len(x)
    near = max(1, min(degree // 2, n - 1))
    wide = min(4 * near, n - 1) if n > 1 else 0
    picks = np.tile((np.arange(n)[:, None] + 1) % n, (1, degree))
    back: list[list[int]] = [[] for _ in range(n)]
    for lo in range(0, n, BLOCK):
        if not wide:
            break
        far = x[lo : lo + BLOCK] @ x.T
        np.negative(far, out=far)
        far[np.arange(len(far)), np.arange(lo, lo + len(far))] = np.inf
        cand = np.argpartition(far, wide - 1, axis=1)[:, :wide]
        cand = np.take_along_axis(cand, np.argsort(np.take_along_axis(far, cand, 1), axis=1, kind="stable"), 1)
        for r, row in enumerate(cand):
            own, mutual = -far[r, row], x[row] @ x[row].T
            chosen: list[int] = []
            for j in range(wide):
                if len(chosen) < near and all(mutual[j, c] <= own[j] for c in chosen):
                    chosen.append(j)
            fill = [j for j in range(wide) if j not in chosen]
            for c, j in enumerate((chosen + fill)[:near]):
                picks[lo + r, c] = row[j]
                back[row[j]].append(lo + r)
    for i, extra in enumerate(back):
        # Nodes that picked this one, spread over those there are, so that hubs keep ways to far parts; the last place is the ring's.
        some = [e for e in dict.fromkeys(extra) if e not in picks[i, :near]]
        step = max(1, len(some) // max(1, degree - near - 1))
        for c, e in enumerate(some[::step][: max(0, degree - near - 1)]):
            picks[i, near + c] = e
    return picks


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, top: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The best `top` nodes and scores that each query finds: all walk at once, each from its best of a few spread nodes to the best not yet opened, until its beam is opened."""
    n, m = len(x), len(q)
    beam = min(max(beam, top), n)
    begin = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))
    seen = np.zeros((m, n), bool)
    seen[:, begin] = True
    ids = np.full((m, beam + max(links.shape[1], len(begin))), -1)
    score = np.full(ids.shape, -np.inf)
    opened = np.zeros(ids.shape, bool)
    ids[:, : len(begin)], score[:, : len(begin)] = begin, q @ x[begin].T
    rows = np.arange(m)
    while len(rows):
        order = np.argsort(-score[rows], axis=1, kind="stable")
        for a in (ids, score, opened):
            a[rows] = np.take_along_axis(a[rows], order, 1)
        ids[rows, beam:], score[rows, beam:], opened[rows, beam:] = -1, -np.inf, False
        closed = ~opened[rows, :beam] & (ids[rows, :beam] >= 0)
        some = closed.any(1)
        rows, at = rows[some], closed[some].argmax(1)
        if not len(rows):
            break
        opened[rows, at] = True
        to = links[ids[rows, at]]
        new = ~seen[rows[:, None], to]
        first = np.ones_like(new)  # a node that a row names twice counts once
        rank = np.argsort(to, axis=1, kind="stable")
        ordered = np.take_along_axis(to, rank, 1)
        np.put_along_axis(first, rank[:, 1:], ordered[:, 1:] != ordered[:, :-1], 1)
        new &= first
        seen[rows[:, None], to] = True
        s = np.where(new, np.einsum("qkd,qd->qk", x[to], q[rows]), -np.inf)
        ids[rows, beam : beam + to.shape[1]], score[rows, beam : beam + to.shape[1]] = np.where(new, to, -1), s
    return ids[:, :top], score[:, :top]


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, which are of one length and without nulls, as rows of an array."""
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"vectors of {sizes['min']} and {sizes['max']} dimensions in one graph")
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        links = graph(_unit(_vectors(rows.column("embedding"))))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(links) + 1, dtype=np.int32) * links.shape[1]), pa.array(links.ravel()))
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("shard", "vec_id", "embedding")] + [pa.array(np.arange(len(links))), lists], names=["shard", "vec_id", "embedding", "node", "links"])

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
            if held and held[0].column("shard")[0].as_py() != shard[lo]:
                yield out()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield out()


def _searched(top: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, [], None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]))) if len(shard) else []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
                if shard[lo] != now:
                    now, held, built = shard[lo], [], None
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if held:
                    rows = pa.Table.from_batches(held)
                    built, held = (rows.column("vec_id").to_numpy(), _unit(_vectors(rows.column("embedding"))), _vectors(rows.column("links"))), []
                    del rows
                if built is None:
                    continue
                ids, x, links = built
                part = part.filter(pc.equal(pc.list_value_length(part.column("embedding")), x.shape[1]))
                for a in range(0, part.num_rows, TOGETHER):
                    asked = part.slice(a, TOGETHER)
                    found, score = walk(x, links, _unit(_vectors(asked.column("embedding"))), top + 1, beam)
                    row, col = np.nonzero((found >= 0) & (score > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(asked.column("vec_id").to_numpy()[row]), pa.array(ids[found[row, col]]), pa.array(score[row, col])], names=["query_id", "vec_id", "score"])

    return run


def indexed(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, vec_id, embedding, node, links of every vector of one dimension, as a table in the shared folder. Null vectors and those with null components are left out, as in `nearest_vectors`."""
    rows = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    shards = max(1, -(-rows.count() // shard_rows))
    placed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding").repartition("shard").sortWithinPartitions("shard", "vec_id")
    return kept(placed.mapInArrow(_built, "shard int, vec_id long, embedding array<double>, node long, links array<long>"), fresh_folder(vectors.sparkSession, "graphs"))


def search(index: DataFrame, queries: DataFrame, top: int, beam: int = BEAM) -> DataFrame:
    """query_id, vec_id, score, rank: the `top` other vectors of positive cosine that a beam of `beam` nodes a shard finds. A wider beam finds more; queries of another dimension find nothing."""
    asked = queries.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    none = F.lit(None).cast("array<long>")
    together = index.select("shard", F.lit(0).alias("kind"), "node", "vec_id", "embedding", "links").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("node"), "vec_id", "embedding", none.alias("links"))
    )
    found = together.repartition("shard").sortWithinPartitions("shard", "kind", "node", "vec_id").mapInArrow(_searched(top, beam), "query_id long, vec_id long, score double").where("query_id <> vec_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def nearest(vectors: DataFrame, queries: DataFrame, top: int, exact_below: int = EXACT) -> DataFrame:
    """`nearest_vectors` for fewer than `exact_below` vectors, `search` over a graph from there on."""
    if vectors.count() < exact_below:
        return nearest_vectors(vectors, queries, top)
    return search(indexed(vectors), queries, top)
