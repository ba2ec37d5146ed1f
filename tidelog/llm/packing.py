"""Best-fit packing of token pieces into fixed-length sequences, in bulk-synchronous rounds.

Pieces of one length are interchangeable, and so are sequences with one gap. So
the range-sorted pieces and gaps are kept as runs: how many pieces have each
length, how many sequences each gap. Both have at most CAPACITY entries whatever
the corpus holds, so the histogram that Spark counts is all that leaves the
executors. Each round takes the longest pieces left, finds by a successor sweep
the smallest gap that holds them, fills as many of that run's sequences as there
are pieces for, updates the gaps and repeats. Which piece gets which place is
resolved by rank: each piece has its rank among the pieces of its length, counted
in salted parts, and looks its rank up in the rounds' table.

The result is that of sequential best-fit decreasing over all pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import Scratch

CAPACITY = 2048
END_ID = 0
#: Words whose ids a Python worker remembers before it starts anew (about 50 bytes each).
REMEMBERED = 1_000_000
#: Words given to the tokenizer at once; each costs about a kilobyte until its ids are taken.
AT_ONCE = 8192
PART_ROWS = 1_000_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of whole words, each distinct word tokenised once.

    Valid for tokenizers that never join text across white space, as those that
    drop white space before merging are.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self._clear()

    def _clear(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def of(self, data: np.ndarray, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of each word's ids in self.ids."""
        if len(self.known) > REMEMBERED:
            self._clear()
        distinct, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            begin, end = w.starts[first[new]].tolist(), w.ends[first[new]].tolist()
            sizes, flat = [], []
            for i in range(0, len(begin), AT_ONCE):
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin[i : i + AT_ONCE], end[i : i + AT_ONCE], strict=True)]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
            size = np.concatenate(sizes)
            start = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, *flat])
            self.known, self.start, self.size = (np.insert(old, at[new], own) for old, own in ((self.known, distinct[new]), (self.start, start), (self.size, size)))
            at = np.searchsorted(self.known, distinct)
        at = at[place.ravel()]
        return self.start[at], self.size[at]


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """Kept by the worker from task to task."""
    return WordIds(path)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, nr = _word_ids(path), 0
        for batch in batches:
            for c in tk.chunks(batch.column("text"), 2 * tk.CHUNK_BYTES):
                w = tk.words(c, tk.EXACT)
                begin = np.zeros(c.rows + 1, np.int64)
                if len(w.hashes):
                    start, size = ids_of.of(c.data, w)
                    np.cumsum(tk.sum_by_row(size, w.first), out=begin[1:])
                    done = np.cumsum(size)
                    flat = ids_of.ids[np.repeat(start - done + size, size) + np.arange(done[-1])]
                else:
                    flat = np.zeros(0, np.uint32)
                flat = np.insert(flat, begin[1:], np.uint32(end_id)).astype("<u4", copy=False)
                begin += np.arange(c.rows + 1)
                raw = flat.view(np.uint8)
                row, piece, at, length, crc, ids = [], [], [], [], [], []
                for r in range(c.rows):
                    for p, a in enumerate(range(begin[r], begin[r + 1], capacity)):
                        b = min(a + capacity, begin[r + 1])
                        row.append(r)
                        piece.append(p)
                        at.append(p * capacity)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(flat[a:b].view(np.int32))
                columns = [
                    batch.column("doc_id").slice(c.lo, c.rows).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(nr, nr + len(row)) % (1 << 30), pa.int64()),
                ]
                nr += len(row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nr"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return run


def best_fit_rounds(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) for each run of placements.

    Pieces of `length` with ranks from `first rank` on go, one each, to that many
    sequences from `first sequence` on, at `offset`. Each round uses up either the
    pieces of a length or a run of sequences, so the table is bounded by the number
    of sizes, not of pieces.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    opened = 0

    def give_back(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[i]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            for many, per in ((full, each), (int(full < n), min(each, left - full * each))):
                if not many or not per:
                    continue
                for j in range(per):
                    placed.append((length, rank, many, first, capacity - gap + j * length))
                    rank += many
                left -= many * per
                give_back(gap - per * length, first, many)
                first, n = first + many, n - many
            give_back(gap, first, n)
    return placed


def _seats(placed: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(placed), np.int64).reshape(-1, 5)
    key, rank0, seq0, offset0 = table[:, 0] * (1 << 48) + table[:, 1], table[:, 1], table[:, 3], table[:, 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            kept = [n for n in batch.schema.names if n not in ("rank", "nr", "part")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(seq0[at] + rank - rank0[at]), pa.array(offset0[at])], names=[*kept, "sequence_id", "offset"])

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids on request.

    `docs` needs doc_id and text; other columns are ignored. Each row is a document
    of its own, repeated ids or null ids included. A null or blank text has the end
    id alone. Only documents of more than `capacity` ids are cut, and only their last
    piece is shorter. An empty table gives no pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nr long" + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(pieces.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, end_id, with_ids), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    parts = max(64, -(-sum(histogram.values()) // PART_ROWS))
    pieces = pieces.withColumn("part", F.col("nr") % parts)
    before = pieces.groupBy("length", "part").count()
    before = before.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("nr", "doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("before")
    )
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nr", *(["ids"] if with_ids else []), "part", "rank"]
    return ranked.select(*names).mapInArrow(_seats(best_fit_rounds(histogram, capacity)), out)
