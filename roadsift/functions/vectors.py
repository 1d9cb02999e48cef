"""Vector expressions on ARRAY columns; heavy loops live in ``operators.similarity``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: x / F.greatest(norm(v), F.lit(FLOOR)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))
