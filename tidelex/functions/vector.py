"""Vector functions on arrays of numbers, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast(DOUBLES), b.cast(DOUBLES), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    # The vector and its length are bound once, not worked out again for each place.
    whole = lambda v: F.transform(F.array(F.greatest(norm(v), F.lit(eps))), lambda n: F.transform(v, lambda x: x / n))[0]
    return F.transform(F.array(a.cast(DOUBLES)), whole)[0]


def cosine_distance(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def head(weights: Column, x: Column) -> Column:
    """tanh of the product of a matrix (array of rows) and a vector."""
    return F.transform(weights, lambda row: F.tanh(dot(row, x)))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)
