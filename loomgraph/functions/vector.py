"""Vector arithmetic in built-in expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the dimensions that both have."""
    a, b = _doubles(a), _doubles(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector is left as it is."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


def cosine_distance(v: Column, query: Column, norm: Column | None = None) -> Column:
    """1 - cosine; 1 where ``v`` has norm zero."""
    n = norm if norm is not None else l2_norm(v)
    return F.lit(1.0) - F.when(n > 0, dot(v, query) / (n * l2_norm(query))).otherwise(0.0)
