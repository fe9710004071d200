"""Result documents: nested JSON lines beside a one-row metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import schemas


def result_documents(items: DataFrame, per_method: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One nested document per item.

    ``items`` has item_id, id, question, options and correct_answer. An item has
    one verdict per method, so its map holds a handful of entries, each with what the
    method judged by (:func:`leakscope.operators.detail.with_detail`); the detections
    and details of single outputs are any number and go to tables of their own
    (:func:`write_detections`, :func:`write_details`).
    """
    entry = F.struct(
        "method", "memorization_score", "is_memorized", "threshold", "error", "outputs", "failed", "shown", "detail"
    )
    per_item = per_method.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("method"), entry))).alias(
            "detection_results"
        )
    )
    nested = (
        items.join(per_item, "item_id", "left")
        .join(verdicts, "item_id", "left")
        .select(
            "id",
            "question",
            "options",
            "correct_answer",
            "detection_results",
            "aggregate_score",
            "is_memorized",
        )
    )
    return nested


def flatten_documents(documents: DataFrame) -> DataFrame:
    """One row per (document, method)."""
    return documents.select(
        "id",
        F.col("aggregate_score"),
        F.col("is_memorized").alias("verdict"),
        F.explode("detection_results").alias("method", "_d"),
    ).select(
        "id",
        "method",
        F.col("_d.memorization_score").alias("memorization_score"),
        F.col("_d.is_memorized").alias("is_memorized"),
        F.col("_d.threshold").alias("threshold"),
        F.col("_d.error").alias("error"),
        F.col("_d.outputs").alias("outputs"),
        F.col("_d.failed").alias("failed"),
        F.col("_d.shown").alias("shown"),
        F.col("_d.detail").alias("detail"),
        "aggregate_score",
        "verdict",
    )


def run_metadata(
    documents: DataFrame, model: str, split: str, methods: list[str], timestamp: str
) -> DataFrame:
    return documents.agg(F.count("*").alias("num_examples")).select(
        F.lit(model).alias("model"),
        F.lit(split).alias("split"),
        "num_examples",
        F.array(*[F.lit(m) for m in methods]).alias("methods"),
        F.lit(timestamp).alias("timestamp"),
    )


def write_run(documents: DataFrame, metadata: DataFrame, path: str) -> None:
    """Results as JSON lines in as many files as there are partitions."""
    documents.write.mode("errorifexists").json(f"{path}/results")
    metadata.write.mode("errorifexists").json(f"{path}/metadata")


def write_detections(detections: DataFrame, path: str) -> None:
    """The detections of single outputs as JSON lines beside the results."""
    detections.write.mode("errorifexists").json(f"{path}/detections")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DETECTIONS).json(f"{path}/detections")


def write_details(details: DataFrame, path: str) -> None:
    """What single outputs were judged by, as JSON lines beside the results."""
    details.write.mode("errorifexists").json(f"{path}/details")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DETAILS).json(f"{path}/details")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULT_DOCUMENT).json(f"{path}/results")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_METADATA).json(f"{path}/metadata")


def read_result_file(spark: SparkSession, path: str) -> DataFrame:
    """A single-document result file: {"metadata": ..., "results": [...]}."""
    fields = ", ".join(
        part.replace(" ", ": ", 1) for part in _fields(schemas.RESULT_DOCUMENT)
    )
    schema = f"results array<struct<{fields}>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    return whole.select(F.explode("results").alias("r")).select("r.*")


def _fields(ddl: str) -> list[str]:
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i].strip())
            start = i + 1
    parts.append(ddl[start:].strip())
    return parts
