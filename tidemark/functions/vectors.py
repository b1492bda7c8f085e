"""Array maths on JVM higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a JVM expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda t, x: t + x)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def distance(a, b) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def softmax(v) -> Column:
    shifted = let(F.array_max(doubles(v)), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def kl_divergence(a, b) -> Column:
    """Divergence of two soft-maxed vectors."""
    return total(F.zip_with(softmax(a), softmax(b), lambda p, q: F.when(p > 0, p * (F.log(p) - F.log(q))).otherwise(0.0)))


def all_equal(v, fill: float = 0.0) -> Column:
    return F.forall(_c(v), lambda x: x == fill)
