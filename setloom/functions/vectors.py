"""Vector columns: dot products, norms and cosine similarity, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, digits: int = 4) -> Column:
    """Clipped and rounded; null if a vector is null or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)), digits))
