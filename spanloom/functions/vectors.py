"""Column functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """Cosine of the angle; norms are at least eps."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def softmax(a: Column | str) -> Column:
    """exp(x) / sum of exp, shifted by the maximum."""
    scaled = F.transform(_col(a), lambda x: F.exp(x - F.array_max(_col(a))))
    return F.transform(F.array(scaled), lambda e: F.transform(e, lambda x: x / total(e)))[0]


def argmax(a: Column | str) -> Column:
    """0-based position of the largest value, the first of equals; null for an empty array."""
    return F.nullif(F.array_position(_col(a), F.array_max(_col(a))), F.lit(0)) - 1


def difference(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)
