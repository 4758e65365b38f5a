"""Vectors as arrays: inner products in double precision, inside whole-stage code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def dot(a: Column, b: Column) -> Column:
    """The inner product; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    size = F.when(norm(a) == 0, 1.0).otherwise(norm(a))
    return F.transform(a, lambda x: x.cast("double") / size)


def unit_query(a: Column) -> Column:
    """A query's vector over its norm plus 1e-8."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + 1e-8))


def nudge(query: Column, target: Column, rate: float = 0.3) -> Column:
    """The query moved towards a target by ``rate``."""
    return F.zip_with(query, target, lambda q, t: q * (1 - rate) + t * rate)
