"""Toxicity by multiple-instance learning: labels of documents teach scores of sentences.

A sentence is toxic with probability sigmoid(bias + weights of its telling words and
beginnings of words), 0 without any. A document is clean if all its sentences are and no leak, one probability
for all documents, strikes it: a noisy-or. It is learned from at most SAMPLE_ROWS labelled
rows, those with the smallest hashes of their ids: Spark counts their words, the FEATURES
that speak most for the label (by likelihood ratio) are kept, and weights are fitted on the
driver. Neither labels nor lang, source or doc_id are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import Scratch

SAMPLE_ROWS = 20_000
FEATURES = 4096
#: Documents that a word must occur in, and its least likelihood ratio (a chance of 1 in 10,000).
LEAST_DOCS = 4
LEAST_RATIO = 15.14
TOXIC = 0.5
#: Lengths in bytes of the beginnings of longer words that count besides the words.
BEGINNINGS = (4, 5, 6, 7, 8)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True
_LETTER[128:] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


@dataclass
class Sentences:
    """Byte spans of a chunk's sentences, the first sentence of each row (rows + 1 values), and the hashes of words and beginnings with their sentences."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    words: np.ndarray
    sentence: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sentences(c: tk.Chunk) -> Sentences:
    """Sentences end with one of ``.!?`` or a line; words are runs of letters, digits, ' and bytes from 128, with A-Z lower-cased."""
    n = len(c.data)
    edge = np.zeros(n + 1, bool)
    edge[c.at] = True
    breaks = edge.copy()
    breaks[1:] |= _END[c.data]
    starts = np.flatnonzero(breaks[:-1])
    ink = np.zeros(n + 2, bool)
    ink[1 : n + 1] = _LETTER[c.data]
    w_starts = np.flatnonzero(ink[1 : n + 1] & (~ink[:n] | edge[:n]))
    w_ends = np.flatnonzero(ink[1 : n + 1] & (~ink[2:] | edge[1:])) + 1
    sums, size = tk.prefix_sums(c.data), w_ends - w_starts
    words = tk.span_hash(sums, w_starts, w_ends)
    for i in np.flatnonzero(size >= tk.LONG_WORD):
        words[i] = xxhash.xxh3_64_intdigest(c.data[w_starts[i] : w_ends[i]].tobytes().lower())
    owner = np.searchsorted(starts, w_starts, "right") - 1
    found = [(words, owner)]
    for k in BEGINNINGS:
        longer = size > k
        found.append((tk.mix(tk.span_hash(sums, w_starts[longer], w_starts[longer] + k) + np.uint64(k)), owner[longer]))
    words, owner = (np.concatenate(x) for x in zip(*found))
    return Sentences(starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, c.at), words, owner)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean rows of a batch hold each word."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for c in tk.chunks(batch.column("text")):
            s = sentences(c)
            _, word = rows = _distinct(s.row[s.sentence], s.words)
            kinds, at = np.unique(word, return_inverse=True)
            bad = np.bincount(at, toxic[c.lo + rows[0]], len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(kinds)) - bad)], names=["word", "bad", "good"])


def _known(s: Sentences, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a sentence and the number of a telling word in it, in order."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.zeros(1 << 20, bool)  # most words leave here
    low[vocabulary & np.uint64(0xFFFFF)] = True
    maybe = np.flatnonzero(low[s.words & np.uint64(0xFFFFF)])
    words = s.words[maybe]
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    hit = vocabulary[at] == words
    return _distinct(s.sentence[maybe[hit]], at[hit])


def _sampled(vocabulary: np.ndarray):
    """Each text's pairs of a sentence and a telling word, as sentence * 2**16 + word."""

    def pairs(text: pa.Array) -> pa.Array:
        at, out = [0], []
        for c in tk.chunks(text):
            s = sentences(c)
            sentence, word = _known(s, vocabulary)
            row = s.row[sentence]
            out.append((sentence - s.first[row]) * (1 << 16) + word)
            at.extend(at[-1] + np.cumsum(np.bincount(row, minlength=c.rows)))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]), pa.int64()))

    return F.arrow_udf(pairs, "array<long>")


@dataclass
class NoisyOr:
    """`vocabulary` (hashes, ascending) with weights; `clean` is the log of the chance that the leak does not strike."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float
    clean: float

    def chunk(self, c: tk.Chunk) -> tuple[np.ndarray, Sentences, np.ndarray, np.ndarray]:
        """Each row's score; the sentences, the numbers of those with telling words, and their scores."""
        s = sentences(c)
        sentence, word = _known(s, self.vocabulary)
        some, at = np.unique(sentence, return_inverse=True)
        z = self.bias + np.bincount(at, self.weights[word], len(some))
        spared = np.bincount(s.row[some], -np.logaddexp(0, z), c.rows)
        return -np.expm1(self.clean + spared), s, some, 1 / (1 + np.exp(-z))


def fit(toxic: np.ndarray, pairs: list[np.ndarray], features: int, rounds: int = 400, rate: float = 0.05, ridge: float = 1.0) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the log chance of no leak, by Adam on the noisy-or likelihood of the documents."""
    doc = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    flat = np.concatenate([*pairs, np.zeros(0, np.int64)]).astype(np.int64)
    word = flat % (1 << 16)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] >> 16 != flat[:-1] >> 16) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    owner, n = doc[new], int(new.sum())
    y = toxic.astype(np.float64)
    x = np.zeros(features + 2)  # weights, bias, leak (logit)
    x[features], x[features + 1] = -1.0, -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        z = x[features] + np.bincount(sentence, x[word], n)
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-x[features + 1]))
        spared = np.log1p(-leak) + np.bincount(owner, -np.logaddexp(0, z), len(y))
        chance = np.exp(np.minimum(spared, -1e-9))
        pull = (1 - y) - y * chance / (1 - chance)  # slope of the loss by -spared
        by_sentence = pull[owner] * p
        g = np.concatenate([np.bincount(word, by_sentence[sentence], features) + ridge * x[:features], [by_sentence.sum(), pull.sum() * leak]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:features], float(x[features]), float(-np.logaddexp(0, x[features + 1]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def detector(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> NoisyOr:
    """Learns from at most `sample_rows` labelled rows that are not held out, those whose ids have the smallest hashes."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order, n = F.xxhash64("doc_id"), texts.select("doc_id").join(usable, "doc_id").count()
    if n > 2 * sample_rows:  # a fifth more than wanted, so that few texts are shuffled besides
        first = order < int(-(2**63) + 2**64 * (1.2 * sample_rows / n))
        texts, usable = texts.where(first), usable.where(first)
    sample = texts.join(usable, "doc_id").orderBy(order, F.xxhash64("text"), "toxic").limit(sample_rows)
    sample = scratch.keep(sample.select("toxic", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "sample")
    n, bad_docs = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad_docs < n:
        return NoisyOr(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(np.log1p(-(bad_docs + 0.5) / (n + 1))))
    words = sample.mapInArrow(_counted, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    a, b, bads, goods = F.col("bad").cast("double"), F.col("good").cast("double"), float(bad_docs), float(n - bad_docs)
    term = lambda seen, own, other: F.when(seen > 0, seen * F.log(seen * n / (own * other))).otherwise(0.0)
    ratio = 2 * (term(a, a + b, bads) + term(b, a + b, goods) + term(bads - a, n - a - b, bads) + term(goods - b, n - a - b, goods))
    telling = words.where((a + b >= LEAST_DOCS) & (a * goods > b * bads)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "word").limit(min(features, 1 << 16))
    vocabulary = np.sort(telling.select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    pairs = sample.select("toxic", _sampled(vocabulary)("text").alias("pairs")).toPandas()
    return NoisyOr(vocabulary, *fit(pairs["toxic"].to_numpy(), list(pairs["pairs"]), len(vocabulary)))


def _located(model: NoisyOr, toxic: float):
    """Each text's score and its sentences that are toxic by themselves, as start:end in code points."""

    def score(text: pa.Array) -> pa.Array:
        scores, spans = [np.zeros(0)], []
        for c in tk.chunks(text):
            value, s, some, own = model.chunk(c)
            scores.append(value)
            found: list[list[str]] = [[] for _ in range(c.rows)]
            lead = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])  # code points before a byte
            for i in some[own >= toxic]:
                r = int(np.searchsorted(s.first, i, "right")) - 1
                found[r].append(f"{lead[s.starts[i]] - lead[c.at[r]]}:{lead[s.ends[i]] - lead[c.at[r]]}")
            spans += [",".join(x) for x in found]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(spans, pa.string())], ["score", "offending"])

    return F.arrow_udf(score, "struct<score: double, offending: string>")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, toxic: float = TOXIC) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, offending.

    `docs` needs doc_id and text, `labels` doc_id and toxic (0 or 1). offending lists the
    sentences whose own score is at least `toxic`, as start:end in code points, end exclusive.
    Null and empty texts, and texts without a telling word, get the leak as their score. Labels
    that are null or belong to no document teach nothing; a doc_id with several labels teaches
    each of them. Without labels of both kinds every score is the share of toxic labels.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _located(detector(docs, labels, sample_rows), toxic)(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", held_out().alias("held_out"), "found.score", (F.col("found.score") >= toxic).cast("int").alias("predicted"), "found.offending")


def offending_sentences(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, toxic: float = TOXIC) -> DataFrame:
    """The toxic sentences themselves: doc_id, start, end (code points, end exclusive), sentence. Edge cases are those of `toxicity`."""
    spans = _located(detector(docs, labels, sample_rows), toxic)(F.col("text").cast("string")).getField("offending")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.explode(F.split(spans, ",")).alias("span")).where("span != ''")
    start, end = (F.split_part("span", F.lit(":"), F.lit(i)).cast("int") for i in (1, 2))
    return each.select("doc_id", start.alias("start"), end.alias("end"), F.substring("text", start + 1, end - start).alias("sentence"))
