"""Hard negatives from k-means inverted lists with stored radii.

Vectors become integers, so scores are exact. A list holds the vectors nearest to one
centroid; by Cauchy-Schwarz, anchor a scores at most a.c + |a| r in a list with centroid c
and radius r, and at least a.c - |a| r. Lists are range-partitioned into shards of at most
SHARD_ROWS vectors, so a large list is spread over several. A shard holds its lists while
anchors stream past it; they take lists by falling bound, skip lists that lie outside their
windows, and stop where the bound falls strictly below the kth score so far. Every anchor
visits the shard of its own list first; what it finds there bounds which other lists, and so
which shards, it is sent to. The centroids, at most LISTS a dimension, are fitted to at most
SAMPLE_ROWS vectors; every vector is indexed and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative scores at least this many hundredths of its positive.
LOW = 80
SAMPLE_ROWS = 8_192
LISTS = 256
SHARD_ROWS = 32_768
#: Vectors of a list that meet a batch of anchors at a time, with a radius of their own.
BLOCK = 2_048
#: Magnitude of an integer component from which scores may not fit a long.
LARGEST = 1 << 27
_LEAST, _MOST = -(1 << 62), 1 << 62


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds from the first k distinct rows; an empty list keeps its centroid."""
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])[:k]
    centroids = x[first].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, centroids)[0]
        size = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centroid."""
    near = (np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * (x @ centroids.T)).argmin(1)
    gap = x - centroids[near]
    return near, np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _by_dim(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, integer vectors) for each dimension in a column."""
    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), int(dim))


def _own(centroids: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return centroids[dim] if dim in centroids else np.zeros((1, dim))


def _assigned(centroids: dict[int, np.ndarray]):
    def assign(q: pa.Array) -> pa.Array:
        list_no, gap = np.zeros(len(q), np.int32), np.zeros(len(q))
        for dim, rows, x in _by_dim(q):
            list_no[rows], gap[rows] = _nearest(x.astype(np.float64), _own(centroids, dim))
        return pa.StructArray.from_arrays([pa.array(list_no), pa.array(gap)], ["list", "gap"])

    return F.arrow_udf(assign, "struct<list: int, gap: double>")


def _bounds(a: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor in each list, with slack for rounding."""
    mid, size = a @ c.T, np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]
    reach = size * radius + 1e-9 * size * (np.sqrt(np.einsum("ij,ij->i", c, c)) + radius) + 0.5
    return mid - reach, mid + reach


def _needed(centroids: dict[int, np.ndarray], radii: dict[int, np.ndarray]):
    """Numbers of the lists that can hold a score within one of an anchor's windows."""

    def needed(q: pa.Array, floors: pa.Array, caps: pa.Array) -> pa.Array:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(q)
        for dim, rows, x in _by_dim(q):
            low, high = _bounds(x.astype(np.float64), _own(centroids, dim), radii[dim])
            for i, r in enumerate(rows):
                f, c = (np.array(v[int(r)].as_py(), np.float64)[:, None] for v in (floors, caps))
                out[r] = np.flatnonzero(((high[i] >= f) & (low[i] <= c)).any(0) & (radii[dim] >= 0)).astype(np.int32)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(needed, "array<int>")


class _Shard:
    """The lists of one shard, cut into blocks with their radii."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids = centroids
        self.held: list[pa.RecordBatch] = []
        self.blocks: dict[int, tuple] | None = None

    def build(self) -> None:
        self.blocks = {}
        if not self.held:
            return
        rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        number = {n: rows.column(n).to_numpy() for n in ("list", "rid", "vec_id", "label")}
        for dim, at, x in _by_dim(rows.column("q")):
            order = np.lexsort((number["vec_id"][at], number["list"][at]))
            at, x = at[order], x[order]
            own = number["list"][at]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            cuts = np.unique(np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(cuts, np.append(cuts[1:], len(at)))]))
            spans = list(zip(cuts, np.append(cuts[1:], len(at))))
            c = _own(self.centroids, dim)[own[cuts]]
            radius = np.array([np.sqrt(((x[a:b] - c[i]) ** 2).sum(1).max()) for i, (a, b) in enumerate(spans)])
            self.blocks[dim] = (spans, c, radius, x, x.astype(np.float64), number["rid"][at], number["vec_id"][at], number["label"][at])
        self.held = []

    def search(self, anchors: pa.RecordBatch, same: bool, k: int) -> Iterator[pa.RecordBatch]:
        number = {n: anchors.column(n).to_numpy() for n in ("rid", "label")}
        for dim, at, a in _by_dim(anchors.column("q")):
            if dim not in self.blocks:
                continue
            floors, caps = (np.stack([np.array(anchors.column(n)[int(r)].as_py(), np.int64) for r in at]) for n in ("floors", "caps"))
            row, window, score, vec_id = self._best(dim, a, number["rid"][at], number["label"][at], floors, caps, same, k)
            yield pa.RecordBatch.from_arrays([pa.array(number["rid"][at][row]), pa.array(window.astype(np.int32)), pa.array(score), pa.array(vec_id)], names=["rid", "place", "score", "vec_id"])

    def _best(self, dim, a, rid, label, floors, caps, same, k):
        spans, c, radius, x, xf, x_rid, x_id, x_label = self.blocks[dim]
        af = a.astype(np.float64)
        low, high = _bounds(af, c, radius)
        exact = dim * float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**52
        m, windows = floors.shape
        best = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(windows)]  # row, score, vec_id
        kth = floors.copy()
        for j in np.argsort(-high.max(0), kind="stable"):
            open_to = (high[:, j, None] >= kth) & (low[:, j, None] <= caps) & (kth <= caps)
            some = np.flatnonzero(open_to.any(1))
            if not len(some):
                continue  # every anchor has stopped before this list or skips it
            lo, hi = spans[j]
            s = np.rint(af[some] @ xf[lo:hi].T).astype(np.int64) if exact else a[some] @ x[lo:hi].T
            fits = (label[some, None] == x_label[None, lo:hi]) == same
            fits &= rid[some, None] != x_rid[None, lo:hi]
            for w in range(windows):
                hit = fits & (s >= kth[some, w, None]) & (s <= caps[some, w, None])
                rows = np.flatnonzero(hit.any(1))
                if not len(rows):
                    continue
                values = np.where(hit[rows], s[rows], _LEAST)
                if values.shape[1] > k:
                    least = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
                    values[values < least[:, None]] = _LEAST
                r, col = np.nonzero(values > _LEAST)
                row, score, ids = (np.concatenate(v) for v in zip(best[w], (some[rows[r]], values[r, col], x_id[lo + col])))
                order = np.lexsort((ids, -score, row))
                row, score, ids = row[order], score[order], ids[order]
                begin = np.searchsorted(row, row)
                place = np.arange(len(row)) - begin
                keep = place < k
                best[w] = (row[keep], score[keep], ids[keep])
                last = place == k - 1
                kth[row[last], w] = np.maximum(kth[row[last], w], score[last])
        window = np.repeat(np.arange(windows), [len(b[0]) for b in best])
        row, score, ids = (np.concatenate(v) for v in zip(*best))
        return row, window, score, ids


def _visitor(centroids: dict[int, np.ndarray], same: bool, k: int):
    """Rows come by shard, lists before anchors; anchors meet the shard's lists batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _Shard(centroids)
        for batch in batches:
            number, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1]))) if len(number) else []
            for lo, hi in zip(cuts, np.append(cuts[1:], len(number)), strict=True):
                if number[lo] != now:
                    now, shard = number[lo], _Shard(centroids)
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    shard.held.append(part)
                    continue
                if shard.blocks is None:
                    shard.build()
                yield from shard.search(part, same, k)

    return run


class _Index:
    def __init__(self, vectors: DataFrame, scratch: Scratch, scale: int):
        self.scratch, spark = scratch, vectors.sparkSession
        e = F.col("embedding").cast("array<double>")
        whole = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST) / scale)), F.lit(False))
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e")).where("vec_id is not null and label is not null").where(whole)
        rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.transform("e", lambda x: F.floor(x * scale).cast("int")).alias("q")), "rows")
        order, n = F.xxhash64("rid"), rows.count()
        sample = rows.where(order < int(-(2**63) + 2**64 * (1.2 * SAMPLE_ROWS / n))) if n > 2 * SAMPLE_ROWS else rows
        sample = sample.orderBy(order, "rid").limit(SAMPLE_ROWS).select("q").toPandas()["q"]
        self.centroids = {}
        for dim in sorted({len(q) for q in sample} - {0}):
            x = np.array([q for q in sample if len(q) == dim], np.float64)
            self.centroids[dim] = kmeans(x, min(LISTS, max(1, int(np.sqrt(len(x))))))
        placed = rows.withColumn("near", _assigned(self.centroids)("q")).select("rid", "vec_id", "label", "q", F.size("q").alias("dim"), "near.list", "near.gap")
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        line = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's
        shard = F.shiftleft(F.shiftright(line, 33), 20) + (line.bitwiseAND((1 << 33) - 1) / SHARD_ROWS).cast("long")
        self.rows = scratch.keep(placed.repartitionByRange(self.parts, "dim", "list", "rid").sortWithinPartitions("dim", "list", "rid").withColumn("shard", shard), "index")
        self.lists = scratch.keep(self.rows.groupBy("dim", "list", "shard").agg(F.max("gap").alias("gap")), "lists")
        self.radii: dict[int, np.ndarray] = {}
        for dim, number, gap in self.lists.groupBy("dim", "list").agg(F.max("gap")).collect():  # at most LISTS rows a dimension
            self.radii.setdefault(dim, np.full(len(_own(self.centroids, dim)), -1.0))[number] = gap

    def visit(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """The best `k` vectors of each anchor and window in the shard it is sent to: rid, place, score, vec_id.

        `anchors` has rid, label, q, shard and as many floors as caps, least and greatest scores.
        """
        lists = self.rows.select("shard", F.lit(0).alias("kind"), "list", "rid", "vec_id", "label", "q", F.lit(None).cast("array<long>").alias("floors"), F.lit(None).cast("array<long>").alias("caps"))
        asked = anchors.select("shard", F.lit(1).alias("kind"), F.lit(0).alias("list"), "rid", F.lit(0).cast("long").alias("vec_id"), "label", "q", "floors", "caps")
        together = lists.unionByName(asked).repartition(self.parts, "shard").sortWithinPartitions("shard", "kind", "list", "rid")
        return together.mapInArrow(_visitor(self.centroids, same, k), "rid long, place int, score long, vec_id long")

    def best(self, anchors: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The best `k` vectors of each anchor's windows: rid, place, score, vec_id, rank."""
        first = self.scratch.keep(self.visit(anchors, same, k), f"{name}_own")
        full = first.groupBy("rid", "place").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        known = full.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", "kth"))).alias("known"))  # a window each
        bounded = anchors.join(known, "rid", "left").withColumn("floors", F.transform("floors", lambda f, i: F.greatest(f, F.coalesce(F.element_at("known", i), f)))).drop("known")
        needed = bounded.select("rid", F.size("q").alias("dim"), F.col("shard").alias("own"), F.explode(_needed(self.centroids, self.radii)("q", "floors", "caps")).alias("list"))
        others = needed.join(self.lists.select("dim", "list", "shard"), ["dim", "list"]).where("shard <> own").select("rid", "shard").distinct()
        rest = self.visit(bounded.drop("shard").join(others, "rid"), same, k)
        by = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "vec_id")
        return self.scratch.keep(first.unionByName(rest).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), name)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels just below the positive.

    `vectors` needs vec_id, embedding (an array of numbers) and an integer label; `is_anchor`
    is a condition on vec_id and label. A component x becomes floor(scale * x) and a row's score
    is its integer inner product with the anchor; higher scores come first, ties by the smaller
    vec_id. Positives are the anchor's first `positives` other rows of its label. Negatives are
    the first `negatives` rows of other labels that score at most as much as the positive and at
    least `low` hundredths of it, so none for a positive with a score below 0. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector, or a component that is null, not finite or at
    least LARGEST / scale in size, take no part. Vectors of different dimensions never meet.
    Rows with one vec_id are rows of their own, as anchors too. Labels that are null where
    `is_anchor` is null make no anchor.
    """
    index = _Index(vectors, Scratch(vectors.sparkSession, "negatives"), scale)
    span = lambda x: F.array(F.lit(x).cast("long"))
    anchors = index.rows.where(is_anchor).select("rid", F.col("vec_id").alias("anchor_id"), "label", "q", "shard")
    ours = index.best(anchors.drop("anchor_id").withColumn("floors", span(_LEAST)).withColumn("caps", span(_MOST)), True, positives, "positives")
    windows = ours.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("w"))  # at most `positives` each
    up = lambda x: ((x + 99 - (x + 99) % 100) / 100).cast("long")  # noqa: E731  hundredths, rounded up
    least = lambda p: F.when(p < 0, F.lit(0).cast("long")).otherwise(up(p * low))
    wide = F.array_repeat(F.lit(_LEAST).cast("long"), F.lit(positives) - F.size("w"))  # unused windows are empty
    asked = anchors.join(windows, "rid").select(
        "rid", "label", "q", "shard", F.concat(F.transform("w", lambda x: least(x["score"])), F.transform(wide, lambda x: x + 1)).alias("floors"), F.concat(F.transform("w", lambda x: x["score"]), wide).alias("caps")
    )
    theirs = index.best(asked, False, negatives, "negatives").select("rid", (F.col("place") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = ours.select("rid", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return theirs.join(pairs, ["rid", "nth"]).join(anchors.select("rid", "anchor_id"), "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
