"""Combining detectors, reporting and threshold choice."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.text import common_prefix_length

Detector = Callable[[], DataFrame]

DETECTION_COLUMNS = (
    "item_id",
    "response_id",
    "method",
    "memorization_score",
    "is_memorized",
    "threshold",
    "error",
)


def as_detections(scored: DataFrame, method: str) -> DataFrame:
    """A detector's rows in the common shape; an error voids score and verdict.

    A detector that judges each output of an item by itself names it in response_id;
    the others judge the item as a whole and leave it null.
    """
    nothing = F.lit(None).cast("string")
    error = F.col("error") if "error" in scored.columns else nothing
    response = F.col("response_id").cast("string") if "response_id" in scored.columns else nothing
    usable = error.isNull()
    return scored.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        response.alias("response_id"),
        F.lit(method).alias("method"),
        F.when(usable, F.col("memorization_score")).alias("memorization_score"),
        F.when(usable, F.col("is_memorized")).alias("is_memorized"),
        F.col("threshold").cast("double").alias("threshold"),
        error.alias("error"),
    )


def run_methods(detectors: dict[str, Detector], methods: list[str]) -> DataFrame:
    """Detections of the chosen methods; ``all`` chooses every one.

    Only the chosen plans are built.
    """
    unknown = set(methods) - set(detectors) - {"all"}
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    chosen = [n for n in detectors if "all" in methods or n in methods]
    if not chosen:
        raise ValueError("no method chosen")
    parts = [as_detections(detectors[name](), name) for name in chosen]
    return reduce(DataFrame.unionByName, parts)


def complete_detections(items: DataFrame, detections: DataFrame, methods: list[str]) -> DataFrame:
    """A row or more for every (item, method); pairs a detector left out become errors."""
    names = F.array(*[F.lit(m) for m in methods])
    pairs = items.select("item_id", F.explode(names).alias("method"))
    if "response_id" not in detections.columns:
        detections = detections.withColumn("response_id", F.lit(None).cast("string"))
    joined = pairs.join(detections, ["item_id", "method"], "left")
    missing = F.col("memorization_score").isNull() & F.col("error").isNull()
    return joined.withColumn(
        "error", F.when(missing, F.lit("no result")).otherwise(F.col("error"))
    ).select(*DETECTION_COLUMNS)


def detection_errors(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("error").isNotNull()).select("item_id", "response_id", "method", "error")


def _half() -> Column:
    """At least half of the verdicts that are there say so; null if none is."""
    votes = F.count("is_memorized")
    return F.when(votes > 0, F.count_if("is_memorized") * 2 >= votes)


def method_verdicts(detections: DataFrame) -> DataFrame:
    """One row per (item, method): the vote of a method over an item's outputs.

    The score is the mean of the working outputs, the verdict is that of at least
    half of them. ``outputs`` counts the judged ones, failed ones included, and
    ``failed`` those with an error; the method has an error, its smallest, only if
    all of them failed. Counts and sums are combined per task before the shuffle, so
    an item may have any number of outputs.
    """
    return detections.groupBy("item_id", "method").agg(
        F.avg("memorization_score").alias("memorization_score"),
        _half().alias("is_memorized"),
        F.max("threshold").alias("threshold"),
        F.when(F.count("error") == F.count("*"), F.min("error")).alias("error"),
        F.count("*").alias("outputs"),
        F.count("error").alias("failed"),
    )


def aggregate_verdict(items: DataFrame, per_method: DataFrame) -> DataFrame:
    """Mean score, and memorized if at least half of the working detectors say so.

    ``per_method`` has a row per (item, method), as :func:`method_verdicts` gives, so
    a method with many outputs has one vote.
    """
    combined = per_method.groupBy("item_id").agg(
        F.avg("memorization_score").alias("aggregate_score"), _half().alias("is_memorized")
    )
    return (
        items.select("item_id")
        .join(combined, "item_id", "left")
        .select(
            "item_id",
            F.coalesce("aggregate_score", F.lit(0.0)).alias("aggregate_score"),
            F.coalesce("is_memorized", F.lit(False)).alias("is_memorized"),
        )
    )


def run_summary(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Memorized of total, and the first item of each kind with question and score."""
    joined = verdicts.join(items.select("item_id", "question"), "item_id")
    example = F.struct("item_id", "question", "aggregate_score")
    summary = joined.agg(
        F.count("*").alias("total"),
        F.count_if("is_memorized").alias("memorized"),
        F.min(F.when(F.col("is_memorized"), example)).alias("_yes"),
        F.min(F.when(~F.col("is_memorized"), example)).alias("_no"),
    )
    columns = ["total", "memorized"]
    for name, struct in (("memorized", "_yes"), ("other", "_no")):
        columns += [
            F.col(f"{struct}.item_id").alias(f"{name}_id"),
            F.col(f"{struct}.question").alias(f"{name}_question"),
            F.col(f"{struct}.aggregate_score").alias(f"{name}_score"),
        ]
    return summary.select(*columns)


def score_histogram(verdicts: DataFrame, score: str = "aggregate_score", bins: int = 10) -> DataFrame:
    """Counts in equal-width bins over the range of the scores, empty bins included."""
    edges = verdicts.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high"))).scalar()
    placed = verdicts.where(F.col(score).isNotNull()).withColumn("_e", edges)
    span = F.col("_e.high") - F.col("_e.low")
    position = F.when(span > 0, F.floor((F.col(score) - F.col("_e.low")) / (span / bins)))
    fallback = F.lit(bins // 2)
    counted = placed.groupBy(
        F.least(F.coalesce(position, fallback), F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count("*").alias("items"))
    every = verdicts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", F.coalesce("items", F.lit(0)).alias("items")
    )


def combined_confidence(
    detections: DataFrame, threshold: float = config.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Mean confidence of the detectors that fired; 0.0 if none did.

    ``detections``: (item_id, is_memorized, confidence).
    """
    fired = F.when(F.col("is_memorized"), F.col("confidence"))
    return (
        detections.groupBy("item_id")
        .agg(F.count(fired).alias("fired"), F.coalesce(F.avg(fired), F.lit(0.0)).alias("confidence"))
        .withColumn("is_memorized", F.col("confidence") > threshold)
    )


def extraction_rates(pairs: DataFrame, expected: Column, produced: Column) -> DataFrame:
    """Share of continuations reproduced in full, and mean share of leading tokens."""
    stored = pairs.select(expected.alias("_e"), produced.alias("_p"))
    shared = common_prefix_length(F.col("_e"), F.col("_p"))
    fraction = F.least(shared, F.size("_e")).cast("double") / F.size("_e")
    scored = stored.withColumn("_f", F.when(F.size("_e") > 0, fraction))
    return scored.agg(
        F.count("_f").alias("items"),
        F.coalesce(F.avg((F.col("_f") == 1.0).cast("double")), F.lit(0.0)).alias("exact_rate"),
        F.coalesce(F.avg("_f"), F.lit(0.0)).alias("fractional_rate"),
    )


def threshold_sweep(
    scored: DataFrame, score: str, label: str, thresholds: list[float], group: str | None = None
) -> DataFrame:
    """Precision and recall of ``score > threshold`` against a 0/1 label.

    The thresholds travel inside the plan; each row meets them in place and is
    combined per task before the shuffle.
    """
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    keys = [group] if group else []
    rows = scored.select(*keys, score, label, F.explode(values).alias("threshold"))
    hit, positive = F.col(score) > F.col("threshold"), F.col(label) == 1
    counts = rows.groupBy(*keys, "threshold").agg(
        F.count_if(hit & positive).alias("true_positives"),
        F.count_if(hit & ~positive).alias("false_positives"),
        F.count_if(~hit & positive).alias("false_negatives"),
    )
    tp = F.col("true_positives")
    flagged, actual = tp + F.col("false_positives"), tp + F.col("false_negatives")
    return counts.withColumn(
        "precision", F.when(flagged > 0, tp / flagged).otherwise(F.lit(0.0))
    ).withColumn("recall", F.when(actual > 0, tp / actual).otherwise(F.lit(0.0)))


def calibrated_verdict(scored: DataFrame, thresholds: DataFrame, dataset: str, score: str) -> DataFrame:
    """Verdict by the threshold of each row's own dataset, one row per dataset."""
    return scored.join(thresholds.select(dataset, "threshold"), dataset, "left").withColumn(
        "is_memorized", F.coalesce(F.col(score) > F.col("threshold"), F.lit(False))
    )
