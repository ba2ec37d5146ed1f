"""Vectorised words and shingles over the byte buffers of Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Words and shingles are 64-bit fingerprints. Work goes chunk by chunk, so memory
follows CHUNK_BYTES and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
#: Bytes from which a word gets a hash of its own kind.
LONG_WORD = 256

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum over i <= t < j of table[data[t]] * base**t."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(_BASE, len(data)), out=s[1:])
    return s


def value_sums(values: np.ndarray) -> np.ndarray:
    """As prefix_sums, of 64-bit values as they are."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=s[1:])
    return s


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans; equal bytes at any place get equal values."""
    return mix((sums[ends] - sums[starts]) * _power(_BASE_INV, len(sums))[starts] + (ends - starts).astype(np.uint64))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


@dataclass
class Chunk:
    """Rows lo:hi of a column: their bytes, and where each row starts in them."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole rows, about `size` bytes at a time; a longer row comes alone."""
    data, at = byte_rows(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """The words of a chunk: byte spans, fingerprints, and the first word of each row (rows + 1 values)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk, table: np.ndarray = _BYTE) -> Words:
    """`table` is EXACT where A-Z and a-z are to differ."""
    n = len(chunk.data)
    ink = np.zeros(n + 2, bool)
    ink[1 : n + 1] = ~_SPACE[chunk.data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.at] = True
    starts = np.flatnonzero(ink[1 : n + 1] & (~ink[:n] | edge[:n]))
    ends = np.flatnonzero(ink[1 : n + 1] & (~ink[2:] | edge[1:])) + 1
    hashes = span_hash(prefix_sums(chunk.data, table), starts, ends)
    # Sums modulo 2**64 do not tell some very long strings apart.
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        raw = chunk.data[starts[i] : ends[i]].tobytes()
        hashes[i] = xxhash.xxh3_64_intdigest(raw if table is EXACT else raw.lower())
    return Words(starts, ends, hashes, np.searchsorted(starts, chunk.at))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each row's k-word runs in order, and where each row's begin.

    A row with 1 to k - 1 words has its whole sequence as its one shingle.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    out = np.zeros(begin[-1], np.uint64)
    short = counts < k
    width = np.repeat(np.where(short, counts, k), n)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    some = bool((short & (counts > 0)).any())
    for j in range(k):
        term = padded[at + j] * _PLACE[j]
        out += np.where(j < width, term, 0) if some else term
    if some:
        out += np.where(width < k, width, 0).astype(np.uint64)
    return mix(out), begin


def distinct_by_row(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and where each row's begin."""
    parts, sizes = [], np.zeros(len(begin), np.int64)
    for r in range(len(begin) - 1):
        own = np.sort(values[begin[r] : begin[r + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        sizes[r + 1] = len(own)
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(sizes)


def sum_by_row(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums over each row's stretch, in any dtype that wraps or adds exactly."""
    s = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=s[1:])
    return s[begin[1:]] - s[begin[:-1]]
