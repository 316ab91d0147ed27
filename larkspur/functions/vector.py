"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where the lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def similarity(distance: Column) -> Column:
    """Cosine similarity of a cosine distance."""
    return 1 - distance


def vector_problem(a: Column, size: int) -> Column:
    """What is wrong with a vector: missing, another size, not finite, zero; null if nothing is."""
    return F.when(a.isNull(), "missing").when(F.size(a) != size, "size").when(~F.coalesce(finite(a), F.lit(False)), "not_finite").when(norm(a) == 0, "zero")
