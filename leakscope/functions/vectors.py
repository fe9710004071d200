"""Dense-vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    """Cosine from stored norms; a zero vector is similar to nothing."""
    return dot(left, right) / F.greatest(left_norm * right_norm, F.lit(EPSILON))
