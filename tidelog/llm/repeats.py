"""Exact repeats of long strings, of bytes or of words, found from sampled suffixes.

A byte goes if a string of 400 bytes that covers it also starts anywhere else; runs of
50 words that also start elsewhere are told apart. Sorting every suffix would ship some
8 bytes for each byte of text, so suffixes are sampled: each window of `length` units is
stood for by the one suffix in it whose `gram` leading units have the smallest
fingerprint. Equal windows choose the same suffix at the same distance, whatever
surrounds them, so nothing is lost. A suffix stands for a run of windows; its context
is the units they span.

1. Suffixes with equal leading units are counted. Where whole contexts are equal,
   all their windows repeat. This settles all but the borders of repeats.
2. Contexts that share leading units but differ are range-partitioned by these, with
   Spark's sampled splitters; each bucket sorts the windows of its contexts, which are
   suffixes cut at `length`, by multikey quicksort, and compares neighbours unit by
   unit; windows whose fingerprint is their own are left out. Equal leading units share a bucket, so no repeat spans a boundary.
   Leading units with more than HOT different contexts are too many for one bucket.
   Their contexts are cut into blocks of STEP windows, by distance from the leading
   units. What all windows of a block have in common is counted: where it
   occurs once, no window repeats. Where whole blocks are equal, all their windows
   repeat. Windows of the few blocks left, at the borders, are counted one by one.
3. Covered units are merged for each document; bytes are cut out, words counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import Scratch


@dataclass(frozen=True)
class Kind:
    """What is compared: windows of `length` units, sampled by the fingerprints of `gram` units."""

    name: str
    length: int
    gram: int
    words: bool

    def units(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The units of a chunk, and where those of each row begin."""
        if not self.words:
            return c.data, c.at
        w = tk.words(c, tk.EXACT)
        return w.hashes, w.first

    def sums(self, units: np.ndarray) -> np.ndarray:
        return tk.value_sums(units) if self.words else tk.prefix_sums(units, tk.EXACT)

    def keys(self, units: np.ndarray) -> tuple[np.ndarray, int]:
        """A sort key for each place, and how many units it holds; past the end they are zero."""
        if self.words:
            return units, 1
        padded = np.concatenate([units, np.zeros(8, np.uint8)]).astype(np.uint64)
        out = np.zeros(len(units), np.uint64)
        for i in range(8):
            out = out << np.uint64(8) | padded[i : i + len(units)]
        return out, 8


BYTES = Kind("bytes", 400, 48, False)
PASSAGES = Kind("words", 50, 8, True)
HOT = 400
STEP = 16
SEGMENT = 1 << 21
POSITION_BITS = np.uint64(24)
GATHER_ROWS = 4096


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours, from running minima of blocks of n."""
    m = len(x)
    y = np.concatenate([x, np.full(-m % n, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, n)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: m - n + 1], left[n - 1 : m])


def multikey_order(keys: np.ndarray, starts: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of `length` units at `starts`, and which equal the one before them in it.

    Multikey quicksort over all groups at once: each round sorts what is still equal by
    its next key and splits it where keys differ; what stands alone is done.
    """
    order = np.argsort(keys[starts], kind="stable")
    first = keys[starts[order]]
    new = np.append(True, first[1:] != first[:-1])[: len(order)]
    changed = True
    for depth in range(step, length, step):
        if changed:
            group = np.cumsum(new) - 1
            open_ = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(open_):
                break
            group = group[open_]
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(begin, len(group)))
        key = keys[starts[order[open_]] + depth]
        differs = key != np.repeat(key[begin], size)
        changed = bool(differs.any())
        if changed:
            torn = np.repeat(np.logical_or.reduceat(differs, begin), size)
            at, of, key = open_[torn], group[torn], key[torn]
            again = np.lexsort((key, of))
            order[at], key = order[at][again], key[again]
            new[at] |= np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))
    return order, ~new


def _suffixes(kind: Kind):
    length, gram = kind.length, kind.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column("text")):
                units, first_unit = kind.units(c)
                for cut in range(0, len(units) - length + 1, SEGMENT):
                    data = units[cut : cut + SEGMENT + length - 1]
                    sums = kind.sums(data)
                    at = np.arange(len(data) - gram + 1)
                    lead = tk.span_hash(sums, at, at + gram)
                    chosen = _sliding_min((lead >> POSITION_BITS << POSITION_BITS) | at.astype(np.uint64), length - gram + 1)
                    chosen = (chosen & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
                    start = np.arange(len(chosen))
                    row = np.searchsorted(first_unit, start + cut, "right") - 1
                    inside = start + cut + length <= first_unit[row + 1]
                    start, chosen, row = start[inside], chosen[inside], row[inside]
                    if not len(start):
                        continue
                    new = np.ones(len(start), bool)
                    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
                    first = np.flatnonzero(new)
                    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
                    at, row = chosen[first], row[first]
                    context = tk.mix(tk.span_hash(sums, lo, hi + length) + (at - lo).astype(np.uint64))
                    of = pa.array(row + c.lo)
                    shift = cut - first_unit[row]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array(lead[at].view(np.int64)), pa.array(context.view(np.int64)), pa.array(lo + shift), pa.array(hi + shift), pa.array(at - lo, pa.int32())],
                        names=["doc_id", "text_key", "lead", "context", "lo", "hi", "anchor"],
                    )

    return run


def _blocks(kind: Kind, data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """Blocks of a context's windows: first start, fingerprints of what all its windows share and of the whole, windows."""
    length = kind.length
    sums = kind.sums(data)
    start = np.arange(len(data) - length + 1)
    block = (at - start) // STEP
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    edge = np.append(first[1:], len(start))
    block = block[first]
    shared = at - block * STEP
    core = tk.mix(tk.span_hash(sums, shared, shared - STEP + 1 + length) + block.astype(np.uint64))
    full = tk.mix(tk.span_hash(sums, first, edge - 1 + length) + (at - first).astype(np.uint64))
    windows = pa.ListArray.from_arrays(pa.array(np.append(0, edge), pa.int32()), pa.array(tk.span_hash(sums, start, start + length).view(np.int64)))
    return first, core.view(np.int64), full.view(np.int64), windows


_WHOLE = ["doc_id", "text_key", "head", "lead", "copies", "lo", "units", "core", "full", "windows"]
_WHOLE_SCHEMA = "doc_id long, text_key long, head long, lead long, copies long, lo long, units binary, core long, full long, windows array<long>"


def _whole(kind: Kind):
    """Contexts that are to be compared, cut out of their documents; hot ones as blocks of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            flat, edge = runs.flatten(), runs.offsets.to_numpy()
            edge = edge - edge[0]
            lead, copies, lo, hi, anchor, hot = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("lead", "copies", "lo", "hi", "anchor", "hot"))
            for c in tk.chunks(batch.column("text")):
                units, first = kind.units(c)
                keys, _ = kind.keys(units)
                own = np.arange(edge[c.lo], edge[c.hi])
                row = np.repeat(np.arange(c.rows), np.diff(edge[c.lo : c.hi + 1]))
                at = first[row] + lo[own]
                # As signed numbers in the order of the leading units.
                head = (keys[at + anchor[own]] ^ np.uint64(1 << 63)).view(np.int64)
                end = first[row] + hi[own] + kind.length
                of = lambda i, row=row, c=c: pa.array(row[i] + c.lo)
                for some in np.array_split(np.arange(len(own)), len(own) // 4096 + 1):
                    cold = some[~hot[own[some]]]
                    n = len(cold)
                    if n:
                        bits = [units[a:b].tobytes() for a, b in zip(at[cold], end[cold], strict=True)]
                        columns = [batch.column("doc_id").take(of(cold)), batch.column("text_key").take(of(cold)), pa.array(head[cold]), pa.array(lead[own[cold]]), pa.array(copies[own[cold]]), pa.array(lo[own[cold]]), pa.array(bits, pa.binary())]
                        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=_WHOLE)
                    for i in some[hot[own[some]]]:
                        begin, core, full, windows = _blocks(kind, units[at[i] : end[i]], int(anchor[own[i]]))
                        n = len(begin)
                        each = np.full(n, i)
                        columns = [batch.column("doc_id").take(of(each)), batch.column("text_key").take(of(each)), pa.array(head[each]), pa.array(lead[own[each]]), pa.array(copies[own[each]]), pa.array(begin + lo[own[i]]), pa.nulls(n, pa.binary())]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(core), pa.array(full), windows], names=_WHOLE)

    return run


def _compare(kind: Kind):
    """Of a bucket sorted by leading units: runs of windows that a neighbour in window order equals."""
    length, width = kind.length, 8 if kind.words else 1

    def out(table: pa.Table) -> pa.RecordBatch:
        data, at = tk.byte_rows(table.column("units"))
        data, at = data[at[0] : at[-1]].view(np.uint64 if kind.words else np.uint8), (at - at[0]) // width
        n = np.diff(at) - length + 1
        row = np.repeat(np.arange(table.num_rows), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        keys, step = kind.keys(data)
        start = at[row] + offset
        # A window with a fingerprint of its own equals no other and needs no place in the order.
        prints = tk.span_hash(kind.sums(data), start, start + length)
        _, place, times = np.unique(prints, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[place.ravel()] > 1)
        order, equal = multikey_order(keys, start[some], length, step)
        repeated = np.zeros(len(start), bool)
        repeated[some[order]] = equal | np.append(equal[1:], False)[: len(order)]
        repeated &= table.column("copies").to_numpy()[row] == 1
        first = repeated & ~(np.concatenate([[False], repeated[:-1]]) & (offset > 0))
        last = repeated & ~(np.concatenate([repeated[1:], [False]]) & (offset + 1 < n[row]))
        i, j = np.flatnonzero(first), np.flatnonzero(last)
        lo = table.column("lo").to_numpy()
        of = pa.array(row[i])
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(of), table.column("text_key").combine_chunks().take(of), pa.array(lo[row[i]] + offset[i]), pa.array(lo[row[j]] + offset[j] + length)], names=["doc_id", "text_key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= GATHER_ROWS:
                table = pa.Table.from_batches(held)
                lead = table.column("lead").to_numpy()
                ends = np.flatnonzero(lead != lead[-1])
                if len(ends):
                    yield out(table.slice(0, int(ends[-1]) + 1).combine_chunks())
                    held = table.slice(int(ends[-1]) + 1).combine_chunks().to_batches()
                    rows = sum(b.num_rows for b in held)
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    return run


def _covered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by the intervals a:b."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tk.byte_rows(batch.column("text"))
            spans = batch.column("spans")
            edge = spans.offsets.to_numpy()
            words, starts, ends = (spans.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("words", "a", "b"))
            shift = edge[0]
            n_bytes, removed, n_spans, digest, passages, kept_text = [], [], [], [], [], []
            for r in range(batch.num_rows):
                own = data[at[r] : at[r + 1]]
                i, j = edge[r] - shift, edge[r + 1] - shift
                of = words[i:j].astype(bool)
                a, b = _covered(starts[i:j][~of], ends[i:j][~of])
                if len(a):
                    kept = np.ones(len(own), bool)
                    for x, y in zip(a, b, strict=True):
                        kept[x:y] = False
                    own = own[kept]
                n_bytes.append(int(at[r + 1] - at[r]))
                removed.append(n_bytes[-1] - len(own))
                n_spans.append(len(a))
                digest.append(hashlib.sha256(own).hexdigest())
                x, y = _covered(starts[i:j][of], ends[i:j][of])
                passages.append(int((y - x).sum()))
                if with_text:
                    kept_text.append(own.tobytes().decode("utf-8", "ignore"))
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_text, pa.string())] * with_text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"] + ["kept_text"] * with_text)

    return run


def _with_rows(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
    side = side.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    return rows.join(side, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), how)


def repeated_spans(rows: DataFrame, kind: Kind, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, a, b: stretches of units whose windows also start elsewhere; they may overlap and come more than once.

    `rows` has doc_id and text_key, which together name a text, and text.
    """
    length = kind.length
    name = lambda x: f"{kind.name}-{x}"
    least = 2 * length - 1 if kind.words else length
    found = scratch.keep(rows.where(F.octet_length("text") >= least).mapInArrow(_suffixes(kind), "doc_id long, text_key long, lead long, context long, lo long, hi long, anchor int"), name("suffixes"))
    contexts = found.groupBy("lead", "context").agg(F.count("*").alias("copies"))
    leads = contexts.groupBy("lead").agg(F.sum("copies").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    leads = scratch.keep(leads.select("lead", "kinds"), name("leads"))  # written, so that hot leading units can be split in the join
    shared = scratch.keep(found.join(leads, "lead"), name("shared"))
    copies = shared.groupBy("lead", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "lo", "hi", "anchor")).alias("one"), F.first("kinds").alias("kinds"))
    copies = scratch.keep(copies, name("contexts"))
    scratch.drop(name("suffixes"))
    full = shared.join(copies.where("copies > 1").select("lead", "context"), ["lead", "context"]).select("doc_id", "text_key", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    differing = copies.where("kinds > 1").select("one.*", "lead", "copies", (F.col("kinds") > HOT).alias("hot"))
    wanted = differing.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lead", "copies", "lo", "hi", "anchor", "hot")).alias("runs"))
    bits = _with_rows(rows, wanted, "inner").select("doc_id", "text_key", "text", "runs")
    bits = scratch.keep(bits.mapInArrow(_whole(kind), _WHOLE_SCHEMA), name("bits"))
    cold = bits.where("units is not null").select("doc_id", "text_key", "head", "lead", "copies", "lo", "units").repartitionByRange("head", "lead").sortWithinPartitions("head", "lead")
    cold = cold.mapInArrow(_compare(kind), "doc_id long, text_key long, a long, b long")
    blocks = bits.where("core is not null").select("doc_id", "text_key", "core", "full", "copies", "lo", "windows")
    each = scratch.keep(blocks.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "lo", "copies", "windows")).alias("one")), name("blocks"))
    alike = blocks.where("copies = 1").join(each.where("n > 1").select("core", "full"), ["core", "full"])
    alike = alike.select("doc_id", "text_key", F.col("lo").alias("a"), (F.col("lo") + F.size("windows") - 1 + length).alias("b"))
    mixed = each.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
    windows = each.join(mixed, "core").select("one.doc_id", "one.text_key", "one.lo", ((F.col("n") == 1) & (F.col("one.copies") == 1)).alias("open"), F.posexplode("one.windows").alias("i", "window"))
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    hot = windows.where("open").join(again, "window").select("doc_id", "text_key", (F.col("lo") + F.col("i")).alias("a"), (F.col("lo") + F.col("i") + length).alias("b"))
    out = scratch.keep(full.unionByName(cold).unionByName(alike).unionByName(hot), name("found"))
    scratch.drop(*(name(x) for x in ("bits", "shared", "contexts", "leads", "blocks")))
    return out


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, and kept_text on request.

    `docs` needs doc_id and text; other columns are ignored. A null text is empty.
    Rows with the same doc_id, or none, are documents of their own, so repeated rows
    lose whatever they share, as all copies do. Bytes alone are removed;
    n_passage_words counts the words in runs of 50 that also start elsewhere, however
    few bytes these have and whatever space parts them. kept_text leaves out characters
    of which only a part was kept; the digest is over the bytes.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    found = [repeated_spans(rows, kind, scratch).withColumn("words", F.lit(kind.words)) for kind in (BYTES, PASSAGES)]
    spans = found[0].unionByName(found[1]).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("words", "a", "b")).alias("spans"))
    joined = _with_rows(rows, spans, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<words:boolean,a:bigint,b:bigint>>")).alias("spans"))
    return joined.mapInArrow(_cut(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + (", kept_text string" if with_text else ""))
