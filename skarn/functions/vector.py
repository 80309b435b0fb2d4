"""Vector functions as Column builders: all arithmetic in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rounded(x: Column, digits: int) -> Column:
    """Rounded, halves away from zero. What rounds to zero keeps its sign, as in SQL on doubles; Spark's round drops it."""
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; as it is if its norm is 0 or within a millionth of 1."""
    n = norm(v)
    return F.when((n == 0) | (F.abs(n - 1) < 1e-6), doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine_similarity(a: Column, b: Column, assume_normalized: bool = False) -> Column:
    """Within -1 and 1; 0 if either norm is 0."""
    if assume_normalized:
        return _clamp(dot(a, b), -1.0, 1.0)
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(_clamp(dot(a, b) / length, -1.0, 1.0))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def vector_distance(a: Column, b: Column, metric: str = "cosine", normalized: bool = True) -> Column:
    if metric == "cosine":
        return 1 - cosine_similarity(a, b, normalized)
    if metric == "dot":
        return -dot(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    raise ValueError(f"metric is one of {METRICS}, not {metric!r}")


def score(distance: Column, metric: str = "cosine", quantization: str = "f32") -> Column:
    """A distance as a score over 0 to 1."""
    if quantization == "bq" or metric == "cosine":
        return _clamp(1 - distance, 0.0, 1.0)
    if metric == "dot":
        return _clamp((1 - distance) / 2, 0.0, 1.0)
    return 1 / (1 + distance)
