"""Vector expressions over array columns; sums run in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes; null for a missing vector."""
    na, nb = norm(a), norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((na < EPS) | (nb < EPS), 0.0).otherwise(dot(a, b) / (na * nb))


def normalized(a: Column) -> Column:
    return F.transform(doubles(a), lambda x: x / F.greatest(norm(a), F.lit(EPS)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)
