"""MinHash near-duplicates by an inverted join over signature coordinates.

Each document's distinct 5-word shingles give COORDS minima. Documents with equal
sets form one class; a class is posted under each (coordinate, value) pair. A pair
of classes is a candidate if at least MATCHES coordinates agree, and a link if the
full sets reach the similarity.

Prefix and skip merging: postings are ordered by how many classes share them, and
each class keeps all but its MATCHES - 1 most shared ones. Two classes that agree
on MATCHES coordinates meet in at least one posting that both keep, so the longest
lists are skipped without losing a candidate.

Large groups: every posting list first meets only its hub (the class with most
copies, then with the most shared coordinates), which is linear. After components
form, only pairs of different parts of a list remain to be tried. Far variants of one
text agree on the threshold pair by pair without being links, so these lists are
merged with a second prefix: the first shingle that two classes have in common, from
rare to common, must leave enough shingles after it on both sides for the similarity.
It is exact, so it only spares pairs that would fail, and holds for lists of any size.
A link at exactly 0.75 is missed with a chance of about 1e-7 (binomial tail of 64 draws).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .graph import components
from .scratch import Scratch
from .tables import fresh

COORDS = 64
MATCHES = 28
SHINGLE = 5
SIMILAR = (75, 100)

_rng = np.random.default_rng(7)
_MULT = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def _signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Upper 32 bits of each row's minimum in each coordinate; rows must not be empty."""
    out = np.empty((len(begin) - 1, COORDS), np.uint32)
    for j in range(COORDS):
        x = values ^ _XOR[j]
        x *= _MULT[j]
        out[:, j] = np.minimum.reduceat(x, begin[:-1]) >> np.uint64(32)
    return out


def _sketch(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("cid", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column("text")):
                w = tk.words(c)
                sets, begin = tk.distinct_by_row(*tk.shingles(w.hashes, w.first, shingle))
                n = np.diff(begin)
                full = np.flatnonzero(n)
                hi, lo = (tk.mix(tk.sum_by_row(tk.mix(sets ^ np.uint64(s)), begin) + n.astype(np.uint64)).view(np.int64) for s in (0x51ED270B, 0xC2B2AE35))
                sig = np.zeros((len(n), COORDS), np.uint32)
                if len(full):
                    sig[full] = _signatures(sets, np.append(begin[full], begin[-1]))
                empty = n == 0
                sizes = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(empty, 0, COORDS), out=sizes[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(c.lo, c.rows), batch.column("text_key").slice(c.lo, c.rows), pa.array(n), pa.array(hi, mask=empty), pa.array(lo, mask=empty), pa.ListArray.from_arrays(pa.array(sizes), pa.array(sig[full].ravel().view(np.int32)))],
                    schema=schema,
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column("text")):
                w = tk.words(c)
                sets, begin = tk.distinct_by_row(*tk.shingles(w.hashes, w.first, shingle))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid").slice(c.lo, c.rows), pa.array([sets[begin[r] : begin[r + 1]].tobytes() for r in range(c.rows)], pa.binary())], names=["cid", "shingles"]
                )

    return run


def _exploded(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column("text")):
                w = tk.words(c)
                sets, begin = tk.distinct_by_row(*tk.shingles(w.hashes, w.first, shingle))
                of = pa.array(np.repeat(np.arange(c.lo, c.hi), np.diff(begin)))
                yield pa.RecordBatch.from_arrays([batch.column("cid").take(of), batch.column("part").take(of), pa.array(np.repeat(np.diff(begin), np.diff(begin))), pa.array(sets.view(np.int64))], names=["cid", "part", "size", "shingle"])

    return run


def _overlap(similar: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last = left = None
            for r, (a, b) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                if last is None or not last.equals(b):
                    last, left = b, np.frombuffer(b.as_buffer(), np.uint64)
                own = np.frombuffer(a.as_buffer(), np.uint64)
                if 100 * min(len(own), len(left)) < similar[0] * max(len(own), len(left)) * 100 // similar[1]:
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(left, own), max(len(left) - 1, 0))
                both = int((left[at] == own).sum()) if len(left) else 0
                keep.append(similar[1] * both >= similar[0] * (len(own) + len(left) - both))
            yield batch.select([n for n in batch.schema.names if n not in ("sa", "sb")]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, group_key, text_key.

    `docs` needs doc_id and text; other columns are ignored. Rows with the same
    doc_id are separate documents. A null or blank text has no shingles and links
    with nothing. component_id is the smallest doc_id reachable by links; null ids
    count only where no row of the component has an id. kept is doc_id =
    component_id. group_key names the component also for rows without an id, and
    text_key is xxhash64 of the text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    sketched = scratch.keep(
        rows.mapInArrow(_sketch(shingle), "doc_id long, text_key long, n_shingles long, hi long, cid long, sig array<int>"), "sketched"
    )
    classes = scratch.keep(
        sketched.where("cid is not null").groupBy("cid", "hi").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep"), F.first("sig").alias("sig")
        ).withColumnRenamed("cid", "lo").withColumn("cid", F.monotonically_increasing_id()),  # equal sets have equal lo and hi; the number tells classes apart
        "classes",
    )
    posts = classes.select("cid", "copies", F.posexplode("sig").alias("pos", "value")).select(
        "cid", "copies", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("post")
    )
    shared = posts.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("cid")
    prefix = posts.join(shared, "post").withColumn("rank", F.row_number().over(own.orderBy("n", "post"))).withColumn("held", F.count("*").over(own)).where(f"rank <= held - {MATCHES - 1}")
    prefix = scratch.keep(prefix.select("cid", "copies", "post", F.sum("n").over(own).alias("support")), "prefix")
    hubs = prefix.groupBy("post").agg(F.max(F.struct("copies", "support", "cid")).alias("top"), F.count("*").alias("n")).where("n > 1").select("post", F.col("top.cid").alias("hub"))
    listed = scratch.keep(prefix.join(hubs, "post").where("cid <> hub").select("post", "cid", "hub"), "listed")
    signature = classes.select("cid", "sig")
    agreed = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)

    def compared(pairs: DataFrame) -> DataFrame:
        """Those pairs that agree on MATCHES coordinates."""
        sides = (signature.select(F.col("cid").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
        return pairs.join(next(sides), "a").join(next(sides), "b").where(agreed >= MATCHES).select(*pairs.columns)

    def texts(wanted: DataFrame) -> DataFrame:
        """`wanted` with one text of each class; a repeated row may give it twice."""
        reps = classes.select("cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")).join(wanted, "cid")
        return rows.join(reps, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select(*wanted.columns, "text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs whose full shingle sets reach the similarity."""
        wanted = pairs.select("a").union(pairs.select("b")).toDF("cid").distinct()
        sets = texts(wanted).mapInArrow(_sets(shingle), "cid long, shingles binary").dropDuplicates(["cid"])
        sides = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        return pairs.join(next(sides), "a").join(next(sides), "b").mapInArrow(_overlap(similar), ", ".join(f"{c} long" for c in pairs.columns))

    # Round 1: every list against its hub.
    star = scratch.keep(compared(listed.select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()), "star")
    links = scratch.keep(confirmed(star), "links-1")
    part = components(links, scratch, "first").withColumnsRenamed({"node": "cid", "root": "part"})
    # Round 2: what is left between different parts of a list, none of it the hub's.
    parted = listed.join(part, "cid", "left").select("post", "cid", F.coalesce("part", "cid").alias("part"))
    mixed = parted.groupBy("post").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("post")
    crowd = parted.join(mixed, "post").select("cid", "part").distinct()
    own = texts(crowd).mapInArrow(_exploded(shingle), "cid long, part long, size long, shingle long").dropDuplicates(["cid", "shingle"])
    seen = own.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # A link shares at least p / (p + q) of both sizes together. In the order from rare to
    # common, the first shingle that both have leaves room for that on either side.
    p, q = similar
    each = Window.partitionBy("cid")
    ranked = own.join(seen, "shingle").withColumn("rank", F.row_number().over(each.orderBy("n", "shingle"))).withColumn("left", F.count("*").over(each) - F.col("rank") + 1)
    rare = scratch.keep(ranked.where(F.col("left") * q >= F.col("size") * p).select("shingle", "cid", "part", "size", "left"), "rare")
    x, y = rare.where(f"left * {p + q} >= size * {2 * p}").alias("x"), rare.alias("y")
    crossed = x.join(y, F.expr(f"x.shingle = y.shingle and struct(x.size, x.cid) < struct(y.size, y.cid) and x.part <> y.part and {q} * x.size >= {p} * y.size and {p + q} * least(x.left, y.left) >= {p} * (x.size + y.size)"))
    crossed = crossed.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.col("x.part").alias("part_a"), F.col("y.part").alias("part_b")).distinct()
    tried = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = scratch.keep(compared(crossed.join(tried, ["a", "b"], "left_anti")), "rest")
    if not rest.isEmpty():
        more = scratch.keep(confirmed(rest).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")), "links-2")
    if not rest.isEmpty() and not more.isEmpty():
        whole = components(more, scratch, "second").withColumnsRenamed({"node": "part", "root": "whole"})
        nodes = part.unionByName(part.select(F.col("part").alias("cid"), "part")).unionByName(more.select(F.col("a").alias("cid"), F.col("a").alias("part"))).unionByName(more.select(F.col("b").alias("cid"), F.col("b").alias("part"))).distinct()
        part = nodes.join(whole, "part", "left").select("cid", F.coalesce("whole", "part").alias("part"))
    labelled = classes.join(part, "cid", "left").select("lo", "hi", F.coalesce("part", "cid").alias("group_key"), "first_id")
    smallest = labelled.groupBy("group_key").agg(F.min("first_id").alias("component_id"))
    named = scratch.keep(labelled.join(smallest, "group_key").select(F.col("lo").alias("cid"), "hi", "group_key", "component_id"), "named")
    scratch.drop("classes", "prefix", "listed", "star", "links-1", "rare", "rest", "links-2", *(f"{a}-{b}" for a in ("first", "second") for b in ("local", "nodes", "met", "top")))
    full = sketched.where("cid is not null").join(named, ["cid", "hi"]).select("doc_id", "n_shingles", "component_id", "group_key", "text_key")
    blank = sketched.where("cid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_key"), "text_key")
    return full.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each near-duplicate group, all columns as they are.

    The row with the group's smallest doc_id stays; of repeated rows with that id
    one stays. Blank texts are no duplicates of each other, except repeated rows. A
    row without an id stays where no row of its group has one.
    """
    no_id, row_id, key, blank, group = fresh(docs, "no_id", "row_id", "row_key", "blank", "group")
    chosen = near_duplicates(docs).where("kept").select(
        F.col("doc_id").isNull().alias(no_id), F.coalesce("doc_id", F.lit(0)).alias(row_id), F.col("text_key").alias(key), F.col("group_key").isNull().alias(blank), F.coalesce("group_key", "text_key").alias(group)
    )
    chosen = chosen.groupBy(no_id, row_id, blank, group).agg(F.min(key).alias(key)).select(no_id, row_id, key)
    named = docs["doc_id"].cast("long")
    keyed = docs.withColumns({no_id: named.isNull(), row_id: F.coalesce(named, F.lit(0)), key: F.xxhash64("text")})
    return keyed.join(chosen, [no_id, row_id, key], "left_semi").dropDuplicates([no_id, row_id, key]).drop(no_id, row_id, key)
