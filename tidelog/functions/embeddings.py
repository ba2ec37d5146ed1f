"""Deterministic hashed vectors of texts, and the identity of their space."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a character and a word add, and the sizes a vector may have.
CHARACTER, WORD, LEAST, MOST = 1, 2, 8, 256
_WORDS = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def _bucket(feature: str, dims: int) -> int:
    return int(hashlib.md5(feature.encode()).hexdigest()[:8], 16) % dims


def counts(text: str | None, dims: int) -> np.ndarray:
    """Weights of a text's letters, digits and words, lower-cased, in the buckets of their md5."""
    v = np.zeros(dims)
    for word in _WORDS.findall((text or "").lower()):
        v[_bucket(word, dims)] += WORD
        for ch in word:
            v[_bucket(ch, dims)] += CHARACTER
    return v


def hashed(text: Column, dims: int = 32) -> Column:
    """Unit vectors, array<double>, of whole texts; a text without letters and digits, or null, has the zero vector. `dims` is kept within LEAST and MOST."""
    dims = min(max(dims, LEAST), MOST)

    def embed(texts: pd.Series) -> pd.Series:
        found = [counts(t, dims) for t in texts]
        return pd.Series([(v / max(np.sqrt(v @ v), 1e-300)).tolist() for v in found])

    return F.pandas_udf(embed, "array<double>")(text)


def space(dims: int = 32) -> str:
    """The identity of the vectors' space: vectors of two spaces are never compared."""
    return f"hashed-words:md5:{CHARACTER}:{WORD}:{min(max(dims, LEAST), MOST)}"
