"""Membership inference: a logistic regression over detector scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.session import stored

STEPS = 8
RIDGE = 1.0


def membership_scores(
    features: DataFrame, key: str, columns: list[str], label: str, steps: int = STEPS, ridge: float = RIDGE
) -> DataFrame:
    """Membership probability per row, fitted on all labelled rows.

    Iteratively reweighted least squares with a fixed number of steps: each is one
    aggregate over the rows, whose weighted cross-products (a row of numbers, by the
    features alone) give the next coefficients. Features are centred and scaled over
    the labelled rows, missing ones count as 0, one without spread plays no part. The
    ridge holds every step solvable, also where a feature separates the classes, where
    only one class occurs (all rows lean to it) or no row is labelled (0.5 for all).
    Rows without a label are scored too; keys may repeat and each row stays.
    """
    complete = features.select(key, F.col(label).cast("int").alias(label), *columns).na.fill(0.0, columns)
    kept = stored(complete, "membership-features")
    labelled = kept.where(F.col(label).isNotNull())
    moments = labelled.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]
    ).first()
    inputs = [F.lit(1.0)] + [_scaled(c, moments[c]["mean"], moments[c]["sd"]) for c in columns]
    weights = np.zeros(len(inputs))
    for _ in range(steps):
        weights = weights + _step(labelled, inputs, label, weights, ridge)
    probability = _probability(inputs, weights)
    return kept.select(
        key, label, probability.alias("membership"), (probability > 0.5).cast("int").alias("prediction")
    )


def _scaled(column: str, mean: float | None, sd: float | None) -> Column:
    return (F.col(column) - F.lit(mean)) / F.lit(sd) if sd else F.lit(0.0)


def _probability(inputs: list[Column], weights: np.ndarray) -> Column:
    total = F.lit(0.0)
    for value, weight in zip(inputs, weights):
        total = total + value * F.lit(float(weight))
    return 1 / (1 + F.exp(-total))


def _step(rows: DataFrame, inputs: list[Column], label: str, weights: np.ndarray, ridge: float) -> np.ndarray:
    """The change of the coefficients from sums over all rows."""
    size = len(inputs)
    spread = F.col("_p") * (1 - F.col("_p"))
    named = rows.select(
        F.col(label).alias("_y"),
        _probability(inputs, weights).alias("_p"),
        *[value.alias(f"_x{i}") for i, value in enumerate(inputs)],
    )
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = named.agg(
        *[F.coalesce(F.sum(spread * F.col(f"_x{i}") * F.col(f"_x{j}")), F.lit(0.0)) for i, j in pairs],
        *[F.coalesce(F.sum((F.col("_y") - F.col("_p")) * F.col(f"_x{i}")), F.lit(0.0)) for i in range(size)],
    ).first()
    curvature = np.eye(size) * ridge
    for (i, j), value in zip(pairs, sums):
        curvature[i, j] += value
        curvature[j, i] = curvature[i, j]
    return np.linalg.solve(curvature, np.array(sums[len(pairs) :]) - ridge * weights)
