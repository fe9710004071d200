"""Tail probabilities of Student's t as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of the continued fraction. Its differences lose digits as the degrees grow:
# p is within 1e-7 up to a million degrees and within 1e-6 at 1e12.
TERMS = 200
# The ratio of gamma functions is moved up by so many steps before it is expanded.
STEPS = 20


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _log_gamma_ratio(a: Column) -> Column:
    """log(gamma(a + 1/2) / gamma(a)) without the logarithms' cancellation for large a."""
    high = a + STEPS
    expanded = F.log(high) / 2 - 1 / (8 * high) + 1 / (192 * high**3) - 1 / (640 * high**5)
    moved = F.aggregate(
        F.sequence(F.lit(0), F.lit(STEPS - 1)), F.lit(0.0), lambda sum_, k: sum_ + F.log((a + k) / (a + k + 0.5))
    )
    return expanded + moved


def _continued_fraction(a: Column, b: Column, x: Column) -> Column:
    """Of the regularised incomplete beta function, from its last term up."""

    def step(rest: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + even / (1 + odd / rest)

    rest = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), step)
    return 1 / (1 - (a + b) * x / ((a + 1) * rest))


def two_sided_p(t: Column, degrees: Column) -> Column:
    """Probability of a value at least as far from 0 as t; null where either is null.

    This is the regularised incomplete beta function of half the degrees and one
    half at degrees / (degrees + t * t), on the side where the fraction converges.
    """

    def beta(v: Column) -> Column:
        half, log_front = F.lit(0.5), v["a"] * -F.log1p(v["ratio"]) + _log_gamma_ratio(v["a"]) - math.log(math.pi) / 2
        outer, inner = 1 / (1 + v["ratio"]), v["ratio"] / (1 + v["ratio"])
        front = F.exp(log_front) * F.sqrt(inner)
        in_tail = outer < (v["a"] + 1) / (v["a"] + 2.5)
        a = F.when(in_tail, v["a"]).otherwise(half)
        fraction = _continued_fraction(a, F.when(in_tail, half).otherwise(v["a"]), F.when(in_tail, outer).otherwise(inner))
        value = front / a * fraction
        return F.when(in_tail, value).otherwise(1 - value)

    values = F.struct((degrees / 2).alias("a"), (t * t / degrees).alias("ratio"))
    return F.when(t.isNotNull() & degrees.isNotNull(), _let(values, beta))
