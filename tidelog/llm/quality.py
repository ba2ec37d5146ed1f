"""Quality classifier: boosted trees over statistics of a document's text.

Statistics of every whole text are computed once, in numpy over Arrow buffers.
The trees are fitted on the driver to a bounded sample of labelled rows
(SAMPLE_ROWS, those with the smallest hashes of their ids) and applied as flat
arrays. Neither labels nor lang, source or doc_id are inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .tables import short_batches
from .trees import Forest, fit

SAMPLE_ROWS = 20_000
ACCEPT = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "distinct_pairs", "repeats_previous",
    "top_word", "single_byte_words", "log_lines", "distinct_lines", "line_words", "upper", "digit", "non_ascii",
    "stop", "comma", "bar", "symbol", "space", "symbol_words", "odd_ends",
)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[[46, 33, 63]] = 4
_KIND[[44, 59, 58]] = 5
_KIND[124] = 6
_KIND[[c for c in b"#$%&*^~<>{}[]=_+\\/@`"]] = 7
_KIND[[32, 9, 10, 11, 12, 13]] = 8


def _share_of_distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's share of distinct values, and of its most frequent value."""
    rows = len(begin) - 1
    size = np.diff(begin)
    row = np.repeat(np.arange(rows), size)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(rows)
    np.maximum.at(most, r[at], runs)
    n = np.maximum(size, 1)
    return np.bincount(r[at], minlength=rows) / n, most / n


def statistics(c: tk.Chunk) -> np.ndarray:
    """Rows by FEATURES."""
    w = tk.words(c)
    n_bytes, n_words = np.diff(c.at), np.diff(w.first)
    b, n = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    row = np.repeat(np.arange(c.rows), n_bytes)
    kinds = np.bincount(row * 9 + _KIND[c.data], minlength=c.rows * 9).reshape(-1, 9)[:, :9] / b[:, None]
    size = (w.ends - w.starts).astype(np.int64)
    longest = np.zeros(c.rows)
    np.maximum.at(longest, w.row, size)
    inner = np.ones(len(w.hashes), bool)
    inner[w.first[:-1][n_words > 0]] = False
    same = np.zeros(len(w.hashes), np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    pair = w.hashes.copy()
    pair[1:] = tk.mix(w.hashes[1:] + w.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15))
    words_distinct, top = _share_of_distinct(w.hashes, w.first)
    pairs_distinct, _ = _share_of_distinct(pair, w.first)
    breaks = np.zeros(len(c.data) + 1, bool)
    breaks[c.at] = True
    breaks[1:] |= c.data == 10
    line_start = np.flatnonzero(breaks[:-1])
    line_hash = tk.span_hash(tk.prefix_sums(c.data), line_start, np.append(line_start[1:], len(c.data)).astype(np.int64))
    line_first = np.searchsorted(line_start, c.at)
    lines = np.diff(line_first)
    lines_distinct, _ = _share_of_distinct(line_hash, line_first)
    first, last = c.data[w.starts], c.data[w.ends - 1]
    odd = lambda x: ((_KIND[x] == 7) | (_KIND[x] == 6)).astype(np.int64)
    return np.stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), tk.sum_by_row(size, w.first) / n, longest, words_distinct, pairs_distinct, tk.sum_by_row(same * inner, w.first) / n,
            top, tk.sum_by_row((size == 1).astype(np.int64), w.first) / n, np.log1p(lines), lines_distinct, n_words / np.maximum(lines, 1), *kinds[:, 1:9].T,
            tk.sum_by_row(((size == 1) & (odd(first) > 0)).astype(np.int64), w.first) / n, tk.sum_by_row(odd(last), w.first) / n,
        ],
        1,
    ).astype(np.float32)


def _measured(text: pa.Array) -> pa.Array:
    x = np.concatenate([*(statistics(c) for c in tk.chunks(text)), np.zeros((0, len(FEATURES)), np.float32)])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))


def _scored(forest: Forest | None):
    def score(text: pa.Array) -> pa.Array:
        parts = [forest.probability(statistics(c).astype(np.float64)) if forest else np.ones(c.rows) for c in tk.chunks(text)]
        return pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64())

    return F.arrow_udf(score, "double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Trees fitted to at most `sample_rows` labelled rows, those whose ids have the smallest hashes; None without both labels."""
    short_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(~held_out())
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(usable, "doc_id")
    order = F.xxhash64("doc_id")
    n = taught.select("doc_id").count()
    if n > 2 * sample_rows:  # a fifth more than wanted, so that the driver is sent few rows besides
        taught = taught.where(order < int(-(2**63) + 2**64 * (1.2 * sample_rows / n)))
    sample = taught.select("doc_id", F.xxhash64("text").alias("text_key"), "quality", F.arrow_udf(_measured, "array<float>")("text").alias("x")).orderBy(order, "text_key", "quality").limit(sample_rows).select("x", "quality").toPandas()
    return fit(np.stack(sample["x"].to_numpy()).astype(np.float64), sample["quality"].to_numpy(np.float64)) if sample["quality"].nunique() == 2 else None


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, accept: float = ACCEPT) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    `docs` needs doc_id and text, `labels` doc_id and quality (0 or 1). Null and
    blank texts are scored like any other, by their statistics, which are zero.
    Labels that are null or belong to no document teach nothing; a doc_id with
    several labels teaches each of them. Without any usable label every score is 1,
    as nothing speaks against a document.
    """
    score = _scored(classifier(docs, labels, sample_rows))(F.col("text").cast("string"))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of `docs` whose text the classifier accepts, all columns as they are. Edge cases are those of `quality`."""
    return docs.where(_scored(classifier(docs, labels))(F.col("text").cast("string")) >= accept)
