"""Distances between vectors as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics where a larger score is better.
SIMILARITIES = ("cosine", "dot")


def _doubles(v: Column | list[float]) -> Column:
    if isinstance(v, list | tuple):
        return F.array(*[F.lit(float(x)) for x in v])
    return v.cast("array<double>")


def dot(a: Column | list[float], b: Column | list[float]) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | list[float]) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | list[float], b: Column | list[float]) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def l2_squared(a: Column | list[float], b: Column | list[float]) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column | list[float], b: Column | list[float]) -> Column:
    return F.sqrt(l2_squared(a, b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_doubles(a), lambda x: x / n)).otherwise(_doubles(a))


def score(a: Column | list[float], b: Column | list[float], metric: str) -> Column:
    """`cosine` and `dot`: the larger the better. `l2`: a distance, the smaller the better."""
    return {"cosine": cosine, "dot": dot, "l2": l2}[metric](a, b)


def from_text(text: Column) -> Column:
    """A vector written as numbers separated by commas."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("float"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6372797.560856) -> Column:
    """Metres between two places on a sphere."""
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2.0 * radius * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))
