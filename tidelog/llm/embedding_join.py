"""Near-duplicate vectors by an epsilon grid order join.

For unit vectors, cosine >= c means distance <= sqrt(2 - 2c), the grid's epsilon.
Equal vectors of a label first become one class with its number of copies. Classes
are projected on the leading principal axes (of differences between vectors of one
label, over all rows), sorted by label and grid cell, and cut into intervals of at
most BLOCK rows. Only intervals whose boxes lie within epsilon are joined, and the
join of two intervals halves them again, skipping parts that are provably apart,
down to LEAF rows, which are compared by a matrix product in double precision.

A joined pair of intervals returns one link count a vector and a spanning forest,
never its links, so dense groups stay linear in what is shuffled. The label alone
never decides where rows go: a hot label or a hot cell is cut like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, settle
from .scratch import Scratch

COSINE = 0.98
AXES = 6
BLOCK = 4096
LEAF = 128
SLACK = 1e-6


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, unit vectors) for the vectors of each dimension in a batch."""
    lists = batch.column("v")
    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, _unit(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), int(dim))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of differences between neighbours with one label, by dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for dim, rows, x in _by_dim(batch):
            order = np.argsort(label[rows], kind="stable")
            d = np.diff(x[order], axis=0)[np.diff(label[rows][order]) == 0]
            total[dim] = total.get(dim, 0) + d.T @ d
    for dim, m in total.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(m.size, dim), pa.int32()), "pos": pa.array(np.arange(m.size), pa.int32()), "value": m.ravel()})


def _project(axes: dict[int, np.ndarray], epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, AXES))
            dims = np.zeros(batch.num_rows, np.int32)
            for dim, rows, x in _by_dim(batch):
                y = x @ axes[dim]
                p[rows, : y.shape[1]] = y
                dims[rows] = dim
            cells = np.floor(p / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("cid", "label", "copies", "v")] + [pa.array(dims)] + [pa.array(cells[:, a]) for a in range(AXES)] + [pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), AXES).cast(pa.list_(pa.float64()))],
                names=["cid", "label", "copies", "v", "dim", *(f"c{a}" for a in range(AXES)), "p"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of a sorted partition: at most BLOCK rows of one label and dimension."""
    held: list[pd.DataFrame] = []

    def block(part: pd.DataFrame) -> dict:
        p = np.stack(part["p"].to_numpy())
        return {
            "block": int(part["cid"].iloc[0]), "label": int(part["label"].iloc[0]), "dim": int(part["dim"].iloc[0]), "lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "cids": part["cid"].to_numpy("<i8").tobytes(),
            "copies": part["copies"].to_numpy("<i8").tobytes(), "p": p.tobytes(), "v": np.concatenate(part["v"].to_numpy()).tobytes(),
        }

    def out(rows: pd.DataFrame) -> pa.RecordBatch:
        found = []
        for _, group in rows.groupby(["label", "dim"], sort=False):
            found += [block(group.iloc[i : i + BLOCK]) for i in range(0, len(group), BLOCK)]
        schema = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), *((n, pa.binary()) for n in ("cids", "copies", "p", "v"))])
        return pa.RecordBatch.from_pylist(found, schema=schema)

    n = 0
    for batch in batches:
        rows = batch.to_pandas()
        n += len(rows)
        held.append(rows)
        if n >= 2 * BLOCK:
            rows = pd.concat(held, ignore_index=True)
            full = len(rows) // BLOCK * BLOCK
            yield out(rows.iloc[:full])
            held, n = [rows.iloc[full:]], len(rows) - full
    if n:
        yield out(pd.concat(held, ignore_index=True))


def _join(cosine: float, epsilon: float, dtype: str):
    reach = (epsilon + SLACK) ** 2

    def pair(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, mx: np.ndarray, my: np.ndarray, same: bool):
        """Links of each row, weighted by copies, and forest edges between rows (y's follow x's)."""
        nx = len(x)
        count_x, count_y = np.zeros(nx, np.int64), np.zeros(len(y), np.int64)
        us, vs = [], []
        todo = [(0, nx, 0, len(y))]
        while todo:
            a, b, c, d = todo.pop()
            if same and d <= a:
                continue
            gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
            if gap @ gap > reach:
                continue
            if b - a > LEAF or d - c > LEAF:
                if b - a >= d - c:
                    todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
                else:
                    todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
                continue
            hit = x[a:b] @ y[c:d].T >= cosine
            if same:
                hit &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            if hit.any():
                count_x[a:b] += hit @ my[c:d]
                count_y[c:d] += mx[a:b] @ hit
                i, j = np.nonzero(hit)
                root = settle(b - a + d - c, i, j + b - a)
                node = np.concatenate([np.arange(a, b), np.arange(c, d) + (0 if same else nx)])
                moved = root != np.arange(len(root))
                us.append(node[moved])
                vs.append(node[root[moved]])
        return count_x, count_y, np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda n, kind, r=r: np.frombuffer(batch.column(n)[r].as_buffer(), kind)
                dim, same = batch.column("dim")[r].as_py(), batch.column("x_block")[r].as_py() == batch.column("y_block")[r].as_py()
                x, y = (_unit(get(f"{s}_v", dtype), dim) for s in "xy")
                ids = [get(f"{s}_cids", "<i8") for s in "xy"]
                cx, cy, u, v = pair(x, y, *(get(f"{s}_p", "<f8").reshape(-1, AXES) for s in "xy"), *(get(f"{s}_copies", "<i8") for s in "xy"), same)
                node = ids[0] if same else np.concatenate(ids)
                count = cx + cy if same else np.concatenate([cx, cy])
                root = settle(len(node), u, v)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array(node[root[some]])], names=["cid", "links", "towards"])

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    `vectors` needs vec_id, embedding (an array of numbers) and an integer label.
    Vectors link when their labels are equal, their dimensions too, and their cosine
    in double precision is at least `cosine`. A null label, a null, empty or zero
    vector, or one with a null or non-finite component links with nothing. Rows with
    the same vec_id are separate vectors. component_id is the smallest vec_id
    reachable, the row's own without links; kept is vec_id = component_id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    epsilon = float(np.sqrt(2 - 2 * cosine))
    double = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    kind, dtype = ("array<double>", "<f8") if double else ("array<float>", "<f4")
    good = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(1), "v", "label")))
    classes = rows.where("good").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    moments = classes.select("label", "v").mapInArrow(_moments, "dim int, pos int, value double").groupBy("dim", "pos").agg(F.sum("value").alias("value"))
    axes = {}
    for dim, m in moments.toPandas().groupby("dim"):  # dim * dim rows for each dimension that occurs
        _, q = np.linalg.eigh(m.sort_values("pos")["value"].to_numpy().reshape(dim, dim))
        axes[int(dim)] = q[:, ::-1][:, : min(AXES, int(dim))]
    schema = f"cid long, label long, copies long, v {kind}, dim int, " + ", ".join(f"c{a} int" for a in range(AXES)) + ", p array<double>"
    order = ["label", "dim", *(f"c{a}" for a in range(AXES)), "cid"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = classes.select("cid", "label", "copies", "v").mapInArrow(_project(axes, epsilon), schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = scratch.keep(
        grid.select("cid", "label", "copies", "v", "dim", "p").mapInArrow(_cut, "block long, label long, dim int, lo array<double>, hi array<double>, cids binary, copies binary, p binary, v binary"), "blocks"
    )
    # Intervals meet in the cells of the first axis that they cover, one cell more on one side.
    box = blocks.select("block", "label", "dim", "lo", "hi")
    cell = lambda c: F.floor(c / F.lit(epsilon + SLACK))
    left = box.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0])))).alias("x")
    right = box.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")[0]) - 1, cell(F.col("hi")[0]) + 1))).alias("y")
    apart = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(AXES - 1)), lambda a: F.greatest(F.lit(0.0), F.col("y.lo")[a] - F.col("x.hi")[a], F.col("x.lo")[a] - F.col("y.hi")[a])), F.lit(0.0), lambda s, g: s + g * g
    )
    near = left.join(right, F.expr("x.label = y.label and x.dim = y.dim and x.cell = y.cell and x.block <= y.block")).where(apart <= (epsilon + SLACK) ** 2)
    near = near.select(F.col("x.block").alias("x_block"), F.col("y.block").alias("y_block")).distinct()
    side = lambda s: blocks.select(F.col("block").alias(f"{s}_block"), *(F.col(n).alias(f"{s}_{n}") for n in ("cids", "copies", "p", "v")))
    joined = near.join(side("x").join(blocks.select(F.col("block").alias("x_block"), "dim"), "x_block"), "x_block").join(side("y"), "y_block")
    found = scratch.keep(joined.mapInArrow(_join(cosine, epsilon, dtype), "cid long, links long, towards long"), "found")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("cid").alias("a"), F.col("towards").alias("b")), scratch, "component")
    named = classes.select("h1", "h2", "cid", "copies", "first_id").join(counts, "cid", "left").join(root.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("good").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
