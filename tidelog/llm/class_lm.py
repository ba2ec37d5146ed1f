"""Class-based bigram language model: p(word | previous) = p(class | previous class) p(word | class).

Texts are dealt into blocks of BLOCK_BYTES and carried as compressed pieces. Every
distinct word of a block is counted there, the counts are summed over blocks, and
go back to the blocks that use them; a block is scored with its own slice of the
counts, so no table of all words is held anywhere.

Words that make up at least FREQUENT of the training tokens (so at most
1 / FREQUENT words) are assigned to CLASSES classes by exchange: each in turn moves
to the class where the likelihood of the class bigrams is greatest, until nothing
moves or ROUNDS are over. Every other word seen MIN_COUNT times or more, so a
vocabulary that grows with the corpus, then moves at once to the class where the same
likelihood gains most, to first order, from the classes found beside it; its contexts
are summed by Spark, and no task holds more than a block's or a batch's words. Words
that are rarer, or never stand beside a classed word, and unseen ones share one class.
A boundary class holds the end token and stands before the first word. Class bigrams
are then counted over all training texts.

The class model is interpolated with the add-half unigram, which alone covers
unseen words; its weight follows the share of words seen once (Good-Turing).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import Scratch

BLOCK_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
FREQUENT = 5e-4
MIN_COUNT = 5
CLASSES = 48
ROUNDS = 6
SMOOTH = 0.1
END = np.uint64(0xE0D0E0D0E0D0E0D0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, blob, doc_ids, learn, sizes): compressed runs of rows."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        ids, learn = batch.column("doc_id"), batch.column("learn")
        for c in tk.chunks(batch.column("text"), PIECE_BYTES):
            block = (part << 24) + total // BLOCK_BYTES
            total += len(c.data)
            whole = pa.array([0, c.rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([packer.compress(c.data)], pa.binary()), *(pa.ListArray.from_arrays(whole, a) for a in (ids.slice(c.lo, c.rows), learn.slice(c.lo, c.rows), pa.array(np.diff(c.at), pa.int64())))],
                names=["block", "blob", "doc_ids", "learn", "sizes"],
            )


def _opened(batch) -> Iterator[tuple[int, pa.Array, np.ndarray, tk.Chunk, tk.Words]]:
    unpacker = zstandard.ZstdDecompressor()
    for r in range(batch.num_rows):
        sizes = np.array(batch.column("sizes")[r].as_py(), np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(unpacker.decompress(batch.column("blob")[r].as_py(), max_output_size=max(1, int(at[-1]))), np.uint8)
        c = tk.Chunk(0, len(sizes), data, at)
        yield batch.column("block")[r].as_py(), batch.column("doc_ids")[r].values, np.array(batch.column("learn")[r].as_py(), bool), c, tk.words(c)


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words and how often its training texts have them; rows of a block follow each other."""
    block, held = None, []

    def out() -> pa.RecordBatch:
        word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, place = np.unique(word, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.full(len(word), block)), pa.array(np.bincount(place.ravel(), n).astype(np.int64))], names=["word", "block", "n"])

    for batch in batches:
        for b, _, learn, _, w in _opened(batch):
            if held and b != block:
                yield out()
                held = []
            block = b
            word, place = np.unique(w.hashes, return_inverse=True)
            held.append((np.append(word, END), np.append(np.bincount(place.ravel(), learn[w.row], len(word)), learn.sum())))
    if held:
        yield out()


@dataclass
class Classes:
    """Classes of words: learned ones from 0, then that of rare and unseen words, then the boundary."""

    words: np.ndarray  # sorted
    of: np.ndarray
    learned: int

    @property
    def rare(self) -> int:
        return self.learned

    @property
    def boundary(self) -> int:
        return self.learned + 1

    @property
    def size(self) -> int:
        return self.learned + 2

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each word stands in self.words; -1 if it does not."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def classes(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, np.append(self.of, self.rare)[places], self.rare)


def _pairs(symbols: np.ndarray, w: tk.Words, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols before and at each token, ends included, and the row of each."""
    now = np.insert(symbols, w.first[1:], boundary)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first) + 1)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[:1] = boundary
    return before, now, row


class Tally:
    """Counts of numbers that come in arrays."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.waiting += len(keys)
        if self.waiting > 2_000_000:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            new, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.keys, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
            self.counts = np.bincount(place.ravel(), np.concatenate([self.counts, n]), len(self.keys)).astype(np.int64)
            self.held, self.waiting = [], 0
        return self.keys, self.counts


def _bigrams(seeds: Classes):
    """Counts of pairs of seeds, all other words and the boundary in training texts."""
    other, boundary = len(seeds.words), len(seeds.words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, _, learn, _, w in _opened(batch):
                at = seeds.places(w.hashes)
                before, now, row = _pairs(np.where(at < 0, other, at), w, boundary)
                tally.add((before * (boundary + 1) + now)[learn[row]])
        keys, counts = tally.total()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    return run


def _contexts(seeds: Classes):
    """Of a block and its words: the seed classes beside each word that is no seed, as (side and class) << 24 | count."""
    size = seeds.size

    def run(pieces: pa.Table, slices: pa.Table) -> pa.Table:
        own = np.sort(slices.column("word").to_numpy().view(np.uint64))
        own = own[seeds.places(own) < 0]
        asked, tally = Classes(own, np.zeros(0, np.int64), 0), Tally()
        for _, _, learn, _, w in _opened(pieces.combine_chunks()):
            before, now, row = _pairs(seeds.classes(seeds.places(w.hashes)), w, seeds.boundary)
            after = np.append(now[1:], seeds.boundary)
            at = np.insert(asked.places(w.hashes), w.first[1:], -1)
            for side, beside in ((0, before), (1, after)):
                some = (at >= 0) & learn[row] & (beside != seeds.rare)
                tally.add(at[some] * (2 * size) + side * size + beside[some])
        keys, counts = tally.total()
        at, code = keys // (2 * size), keys % (2 * size)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        entries = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array((code << 24 | np.minimum(counts, (1 << 24) - 1)).astype(np.uint32).view(np.int32)))
        return pa.table({"word": pa.array(own[at[first]].view(np.int64)), "entries": entries})

    return run


def _chosen(gain: np.ndarray, size: int):
    """Of rows sorted by word: each word with the class that its contexts favour most; a tie goes to the lowest."""

    def told(words: np.ndarray, contexts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array((contexts @ gain).argmax(1), pa.int32())], names=["word", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = np.zeros(0, np.int64), np.zeros((0, 2 * size))
        for batch in batches:
            if not batch.num_rows:
                continue
            word, entries = batch.column("word").to_numpy(), batch.column("entries")
            words, place = np.unique(np.append(last, word), return_inverse=True)
            place = np.repeat(place.ravel()[len(last) :], np.diff(entries.offsets.to_numpy()))
            flat = entries.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.int64)
            contexts = np.bincount(place * (2 * size) + (flat >> 24), flat & 0xFFFFFF, len(words) * 2 * size).reshape(-1, 2 * size)
            contexts[np.searchsorted(words, last)] += held
            yield told(words[:-1], contexts[:-1]) if words[-1] == word[-1] else told(words, contexts)
            last, held = words[-1:], contexts[-1:]
        if len(last):
            yield told(last, held)

    return run


def _block_classes(slices: pa.Table, learned: int) -> Classes:
    word = slices.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return Classes(word[order], slices.column("cls").to_numpy()[order].astype(np.int64), learned)


def _class_pairs(learned: int):
    def run(pieces: pa.Table, slices: pa.Table) -> pa.Table:
        classes, tally = _block_classes(slices, learned), Tally()
        for _, _, learn, _, w in _opened(pieces.combine_chunks()):
            before, now, row = _pairs(classes.classes(classes.places(w.hashes)), w, classes.boundary)
            tally.add((before * classes.size + now)[learn[row]])
        keys, counts = tally.total()
        return pa.table({"pair": keys, "n": counts})

    return run


def exchange(bigrams: np.ndarray, movable: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol. The first `movable` symbols go to classes 0 to classes - 1; the others keep one of their own.

    Starts from frequency order dealt round, then moves one word at a time to the
    class where the sum of n log n over class pairs, less that over classes, is
    greatest; a tie stays or goes to the lowest class.
    """
    size = len(bigrams)
    of = np.arange(size) - movable + classes
    of[:movable] = np.argsort(np.argsort(-bigrams[:movable].sum(1), kind="stable"), kind="stable") % classes
    k = classes + size - movable
    right, left = np.zeros((movable, k)), np.zeros((movable, k))
    for w in range(movable):
        right[w] = np.bincount(of, bigrams[w], k)
        left[w] = np.bincount(of, bigrams[:, w], k)
    grid = np.zeros((k, k))
    np.add.at(grid, (of[:, None].repeat(size, 1), of[None, :].repeat(size, 0)), bigrams)
    h = lambda x: x * np.log(np.maximum(x, 1))
    own = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-bigrams[:movable].sum(1), kind="stable"):
            a, s = of[w], bigrams[w, w]
            r, m = right[w].copy(), left[w].copy()
            r[a] -= s
            m[a] -= s
            grid[a] -= r
            grid[:, a] -= m
            grid[a, a] -= s
            rows, cols = grid[:classes], grid[:, :classes].T
            gain = (h(rows + r) - h(rows)).sum(1) + (h(cols + m) - h(cols)).sum(1)
            d = grid[own, own]
            gain += h(d + r[own] + m[own] + s) - h(d + r[own]) - h(d + m[own]) + h(d)
            for tot, add in ((rows.sum(1), r.sum() + s), (cols.sum(1), m.sum() + s)):
                gain -= h(tot + add) - h(tot)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += m
            grid[b, b] += s
            if b != a:
                of[w] = b
                moved += 1
                right[:, a] -= bigrams[:movable, w]
                right[:, b] += bigrams[:movable, w]
                left[:, a] -= bigrams[w, :movable]
                left[:, b] += bigrams[w, :movable]
        if not moved:
            break
    return of


def _scored(learned: int, follow: np.ndarray, class_n: np.ndarray, tokens: int, vocabulary: int, weight: float):
    low = tokens + 0.5 * (vocabulary + 1)

    def run(pieces: pa.Table, slices: pa.Table) -> pa.Table:
        count = slices.column("n").to_numpy()[np.argsort(slices.column("word").to_numpy().view(np.uint64))]
        classes = _block_classes(slices, learned)
        parts = []
        for _, ids, learn, c, w in _opened(pieces.combine_chunks()):
            places = classes.places(w.hashes)
            a, b, row = _pairs(classes.classes(places), w, classes.boundary)
            n = count[np.insert(places, w.first[1:], classes.places(np.array([END])))].astype(np.float64)
            unigram = (n + 0.5) / low
            by_class = follow[a, b] * n / np.maximum(class_n[b], 1)
            total = lambda x, row=row, c=c: np.bincount(row, x, c.rows)
            size = np.diff(w.first) + 1
            parts.append(
                pa.table(
                    {"doc_id": ids, "held_out": pa.array(~learn), "n_tokens": pa.array(size), "n_known": pa.array(total(n > 0).astype(np.int64)), "train_tokens": pa.array(np.full(c.rows, tokens)), "base_score": pa.array(total(np.log10(unigram))), "score": pa.array(total(np.log10(weight * by_class + (1 - weight) * unigram)))}
                )
            )
        return pa.concat_tables(parts)

    return run


def _summed(of: np.ndarray, bigrams: np.ndarray, size: int) -> np.ndarray:
    grid = np.zeros((size, size))
    np.add.at(grid, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), bigrams)
    return grid


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    `docs` needs doc_id and text; other columns are ignored. Held out are rows whose
    crc32 of doc_id as text leaves 1 modulo 5; all others, also those without an id,
    teach. A null or blank text is its end token alone. base_score is that of the
    add-half unigram, score that of the class model; both are log10. With nothing to
    learn from, every token is unseen and both are 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "class-lm")
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learn.alias("learn"))
    pieces = scratch.keep(rows.mapInArrow(_pieces, "block long, blob binary, doc_ids array<long>, learn array<boolean>, sizes array<long>"), "pieces")
    uses = scratch.keep(pieces.mapInArrow(_uses, "word long, block long, n long"), "uses")
    counts = scratch.keep(uses.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n, v, once = counts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    end = int(END.view(np.int64))
    slices = scratch.keep(uses.select("block", "word").join(counts, "word"), "slices")
    scratch.drop("uses")
    # The most frequent words, one by one.
    frequent = counts.where((F.col("n") >= max(MIN_COUNT, FREQUENT * n)) & (F.col("word") != end)).select("word").toPandas()["word"]  # at most 1 / FREQUENT rows
    seeds = Classes(np.sort(frequent.to_numpy(np.int64).view(np.uint64)), np.zeros(0, np.int64), 0)
    pairs = pieces.mapInArrow(_bigrams(seeds), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    symbols = len(seeds.words) + 2
    bigrams = np.zeros((symbols, symbols))
    bigrams.ravel()[pairs["pair"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.float64)
    seeds.learned = min(CLASSES, max(1, len(seeds.words)))
    of = exchange(bigrams, len(seeds.words), seeds.learned)
    seeds.of = of[: len(seeds.words)]
    grid = _summed(of, bigrams, seeds.size)
    # All other words from MIN_COUNT on, at once, by the seed classes beside them.
    beside = np.ones(seeds.size, bool)
    beside[seeds.rare] = False
    own = np.stack([grid[:, : seeds.learned], grid[: seeds.learned].T]) + SMOOTH
    own = (np.log(own) - np.log(own[:, beside].sum(1))[:, None]) * beside[:, None]
    vocabulary = slices.where((F.col("n") >= MIN_COUNT) & (F.col("word") != end))
    contexts = pieces.groupBy("block").cogroup(vocabulary.select("block", "word").groupBy("block")).applyInArrow(_contexts(seeds), "word long, entries array<int>")
    chosen = contexts.repartition("word").sortWithinPartitions("word").mapInArrow(_chosen(own.reshape(-1, seeds.learned), seeds.size), "word long, cls int")
    seeded = spark.createDataFrame(pd.DataFrame({"word": seeds.words.view(np.int64), "cls": seeds.of.astype(np.int32)}), "word long, cls int")
    classes = scratch.keep(chosen.unionByName(seeded), "classes")
    known = vocabulary.join(classes, "word", "left").withColumn("cls", F.coalesce("cls", F.lit(seeds.rare)))
    known = scratch.keep(known.select("block", "word", "n", "cls"), "known")
    follow = pieces.groupBy("block").cogroup(known.select("block", "word", "cls").groupBy("block")).applyInArrow(_class_pairs(seeds.learned), "pair long, n long")
    follow = follow.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # a row for each pair of classes at most
    grid = np.zeros((seeds.size, seeds.size))
    grid.ravel()[follow["pair"].to_numpy(np.int64)] = follow["n"].to_numpy(np.float64)
    class_n = grid.sum(0)
    alive = class_n > 0
    follow = (grid + SMOOTH * alive) / np.maximum(grid.sum(1) + SMOOTH * alive.sum(), 1e-9)[:, None]
    weight = 1 - min(0.5, max(0.02, 2 * once / n)) if n else 0.0
    rare = slices.where((F.col("n") < MIN_COUNT) | (F.col("word") == end)).select("block", "word", "n", F.when(F.col("word") == end, seeds.boundary).otherwise(seeds.rare).alias("cls"))
    scored = pieces.groupBy("block").cogroup(known.unionByName(rare).groupBy("block")).applyInArrow(_scored(seeds.learned, follow, class_n, int(n), int(v), weight), SCORES)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
