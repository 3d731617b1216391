"""Vector arithmetic on ``array<float>`` columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulith.session import col


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(_dot(col(v), col(v)))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; the zero vector stays as it is."""
    v = col(v)
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.try_divide(_dot(a, b), l2_norm(a) * l2_norm(b))


def blend(v: Column | str, t: Column | str, alpha: float = 0.6) -> Column:
    return F.lit(alpha) * col(v) + F.lit(1 - alpha) * col(t)
