"""Integer shares, vectors and sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of longs that are not negative; a division of doubles is inexact beyond 2**53."""
    return ((a.cast("long") - F.pmod(a.cast("long"), b.cast("long"))).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")


def scaled(part: Column, whole: Column, scale: int = 10_000) -> Column:
    """floor(part * scale / whole); 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(_div(part * scale, F.nullif(whole, F.lit(0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, not below 0; 0 for different dimensions, zero vectors and nulls."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), dot(a, b) / F.nullif(norm, F.lit(0.0)))), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller counts over sum of larger ones of two maps of counts; 1 if both are empty."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("low"), F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("high"))))
    add = lambda name: F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x[name])
    return F.when(F.size(both) == 0, 1.0).otherwise(add("low") / F.nullif(add("high"), F.lit(0)))


def is_suffix(longer: Column, shorter: Column) -> Column:
    """Whether an array ends with another, in order; every array ends with an empty one."""
    n = F.size(shorter)
    return F.when(n == 0, True).when(n > F.size(longer), False).otherwise(F.slice(longer, F.greatest(F.lit(1), F.size(longer) - n + 1), n) == shorter)


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance between two closed intervals, 0 where they meet."""
    return F.greatest(F.lit(0).cast("long"), b0 - a1, a0 - b1)
