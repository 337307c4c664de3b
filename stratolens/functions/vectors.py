"""Column functions on vectors (arrays of float or double); sums are of doubles, in order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (length(a) * length(b))


def unit(a: Column) -> Column:
    n = length(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def is_valid(a: Column, dims: int) -> Column:
    """Of the right length, all finite, and not all zero."""
    return (F.size(a) == dims) & F.exists(a, lambda x: x != 0) & ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
