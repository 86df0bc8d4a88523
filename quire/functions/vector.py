"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if either vector is null, and over the longer one if the lengths differ (missing elements are null)."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def raw_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine clamped to [0, 1], as the index and the memory use it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw_cosine(a, b)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    diff = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v)


def distance_similarity(distance: Column) -> Column:
    """1 minus the distance clamped to [0, 1]: the store's similarity."""
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance))


def mean_vector(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") + y.cast("double")) / 2)
