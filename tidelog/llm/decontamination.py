"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

Every window of a document that has as many words as some benchmark item is a
candidate place. A window that shares no 5-word shingle with any item has similarity
0 and is never fingerprinted. The others get a 64-bit SimHash of their shingles,
weighted by how often each occurs, from running sums over the document. Fingerprints
are looked up in BLOCKS bit blocks: two that differ in at most RADIUS bits agree up
to RADIUS // BLOCKS bits in some block, and the index lists an item under all such
values, so no fingerprint within the radius is missed. Hits are verified by the
weighted Jaccard similarity, sum of smaller counts over sum of larger ones.

A window at exactly 0.75 whose shingles differ from each other has an expected distance
of 11 bits; the chance that it lies beyond RADIUS is about 1e-6. Shingles that occur
again and again in a window sway its fingerprint together, so windows with AGAIN or
more repeats are verified without it. The benchmark is taken in blocks of about
BLOCK_ITEMS items, so what a task holds does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .tables import short_batches

SHINGLE = 5
SIMILAR = 0.75
RADIUS = 26
BLOCKS = 8
BLOCK_ITEMS = 8192
#: Repeated shingles from which a window is verified whatever its fingerprint.
AGAIN = 4
#: Window starts fingerprinted at once.
STARTS = 1 << 15

_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS


def _votes(shingles: np.ndarray) -> np.ndarray:
    """Running sums of each bit's votes, one row more than shingles."""
    out = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(((tk.mix(shingles)[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1, axis=0, out=out[1:])
    return out


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    return ((votes > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


@dataclass
class Items:
    """Items of one window size: their fingerprints, the block index, and their shingles with counts."""

    width: int
    ids: list[int]
    prints: np.ndarray
    index: np.ndarray  # BLOCKS x 256 x items: may an item lie within the radius?
    sets: list[tuple[np.ndarray, np.ndarray]]


def index_items(items: list[tuple[int, str | None]]) -> tuple[dict[int, Items], np.ndarray, np.ndarray]:
    """Items by window size, and all their shingles (sorted) with the sizes that have them, as pairs."""
    column = pa.array([t for _, t in items], pa.string())
    by_size: dict[int, list] = {}
    pairs: set[tuple[int, int]] = set()
    for c in tk.chunks(column):
        w = tk.words(c)
        s, begin = tk.shingles(w.hashes, w.first, SHINGLE)
        for r in range(c.rows):
            own = s[begin[r] : begin[r + 1]]
            if len(own):
                width = int(w.first[r + 1] - w.first[r])
                by_size.setdefault(width, []).append((items[c.lo + r][0], own))
                pairs.update((int(x), width) for x in own)
    out = {}
    for width, found in by_size.items():
        prints = np.array([_fingerprints(_votes(own)[-1:])[0] for _, own in found], np.uint64)
        index = np.stack([_NEAR[:, ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)] for b in range(BLOCKS)])
        out[width] = Items(width, [i for i, _ in found], prints, index, [np.unique(own, return_counts=True) for _, own in found])
    ordered = sorted(pairs)
    return out, np.array([p[0] for p in ordered], np.uint64), np.array([p[1] for p in ordered], np.int64)


def _similarities(own: np.ndarray, span: int, item: tuple[np.ndarray, np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of the windows own[p : p + span] and an item, for each start p."""
    words, counts = item
    lo, hi = starts[0], starts[-1] + span
    part = own[lo:hi]
    at = np.minimum(np.searchsorted(words, part), len(words) - 1)
    seen = np.zeros((len(part) + 1, len(words)), np.int32)
    hit = words[at] == part
    seen[1:][np.flatnonzero(hit), at[hit]] = 1
    np.cumsum(seen, axis=0, out=seen)
    both = np.minimum(seen[starts - lo + span] - seen[starts - lo], counts).sum(1)
    return both / (span + counts.sum() - both)


def _search(items: dict[int, Items], shingles: np.ndarray, widths: np.ndarray, similar: float):
    def document(own: np.ndarray, hits: np.ndarray, sizes: np.ndarray, n_words: int) -> dict[int, tuple[float, int, int]]:
        best: dict[int | None, tuple[float, int, int]] = {}
        order = np.argsort(own, kind="stable")
        apart = np.full(len(own), len(own) + 1)  # distance to the last place of the same shingle
        apart[order[1:]] = np.where(own[order[1:]] == own[order[:-1]], np.diff(order), len(own) + 1)
        for width in np.unique(sizes):
            group = items[int(width)]
            span = min(max(1, int(width) - SHINGLE + 1), len(own))
            again = np.concatenate([[0], np.cumsum(apart < span)])
            edge = np.zeros(len(own) - span + 2, np.int64)
            q = hits[sizes == width]
            np.add.at(edge, np.maximum(q - span + 1, 0), 1)
            np.add.at(edge, np.minimum(q, len(own) - span) + 1, -1)
            wanted = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            runs = [x for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > span) + 1) for x in np.array_split(run, len(run) // STARTS + 1) if len(x)]
            for starts in runs:
                votes = _votes(own[starts[0] : starts[-1] + span])
                prints = _fingerprints(votes[starts - starts[0] + span] - votes[starts - starts[0]])
                near = np.zeros((len(starts), len(group.ids)), bool)
                near[again[starts + span] - again[starts] >= AGAIN] = True
                for b in range(BLOCKS):
                    near |= group.index[b][((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
                p, i = np.nonzero(near)
                close = (np.bitwise_count(prints[p] ^ group.prints[i]) <= RADIUS) | (again[starts + span] - again[starts] >= AGAIN)[p]
                p, i = p[close], i[close]
                for k in np.unique(i):
                    places = starts[p[i == k]]
                    sims = _similarities(own, span, group.sets[k], places)
                    top = int(sims.argmax())
                    found = (float(sims[top]), -int(places[top]), min(int(width), n_words))
                    if found[0] >= similar and found > best.get(group.ids[k], (0.0, 0, 0)):
                        best[group.ids[k]] = found
        return best

    def each(text: pa.Array) -> Iterator[tuple[int, int | None, float, int, int]]:
        """(row, item, similarity, start, words) of each row of a column and item it holds."""
        for c in tk.chunks(text):
            w = tk.words(c)
            s, begin = tk.shingles(w.hashes, w.first, SHINGLE)
            lo, hi = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
            hits = np.flatnonzero(hi > lo)
            row = np.searchsorted(begin, hits, "right") - 1
            for r in np.unique(row):
                own = hits[row == r]
                n = hi[own] - lo[own]
                sizes = widths[np.repeat(lo[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                best = document(s[begin[r] : begin[r + 1]], np.repeat(own - begin[r], n), sizes, int(w.first[r + 1] - w.first[r]))
                for item, (sim, start, words) in sorted(best.items(), key=lambda x: (x[0] is None, x[0])):
                    yield c.lo + int(r), item, sim, -start, words

    return each


def _matches(each):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(each(batch.column("text")))
            columns = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def _holds(each):
    def holds(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        out[[f[0] for f in each(text)]] = True
        return pa.array(out)

    return F.arrow_udf(holds, "boolean")


def _searches(benchmark: DataFrame, similar: float) -> list:
    """A search for each block of items."""
    short_batches(benchmark.sparkSession)
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = max(1, -(-asked.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [_search(*index_items([(r["item_id"], r["text"]) for r in asked.where(block == b).collect()]), similar) for b in range(n)]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document row and item it holds: doc_id, item_id, similarity, start_word, n_words.

    `docs` needs doc_id and text, `benchmark` item_id and text. The row tells the most
    similar window (the first of equal ones). A document with fewer words than an item
    is one window. Null and blank texts match nothing on either side. Items with one
    item_id, or with none, count as versions of one item; the id of those is null.
    Rows of `docs` with one doc_id are separate documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [rows.mapInArrow(_matches(each), "doc_id long, item_id long, similarity double, start_word long, n_words long") for each in _searches(benchmark, similar)]
    return reduce(DataFrame.unionByName, found)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, all columns as they are. Items need no id; other edge cases are those of `benchmark_matches`."""
    for each in _searches(benchmark, similar):
        docs = docs.where(~_holds(each)(F.col("text").cast("string")))
    return docs
