"""Row-completion tests and column entropy for tabular data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.text import strip
from leakscope.sources.questions import seeded_sample


def column_entropy(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shannon entropy in bits of each column; nulls do not count.

    With value counts c of total n, H = log2(n) - sum(c * log2(c)) / n, so one
    grouping of the values is enough and needs no join with the totals.
    """
    names = columns or table.columns
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]
    )
    rows = table.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull())
    counts = rows.groupBy("column", "value").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy("column").agg(
        F.count("*").alias("distinct_values"),
        (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"),
    )


def prefix_columns_of(table: DataFrame, prefix_columns: list[str] | None = None) -> list[str]:
    return prefix_columns or table.columns[: len(table.columns) // 2]


def row_prompts(
    table: DataFrame,
    row_id: str,
    prefix_columns: list[str] | None = None,
    sample_rows: int | None = 100,
    seed: int = 42,
) -> DataFrame:
    """Prompt with the first half of the columns for a sample of rows, or for all."""
    shown = prefix_columns_of(table, prefix_columns)
    lines = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan")), F.lit("\n"))
        for c in shown
    ]
    rows = table if sample_rows is None else seeded_sample(table, sample_rows, row_id, seed)
    return rows.select(
        F.col(row_id).alias("row_id"),
        F.concat(F.lit(config.ROW_PROMPT_HEADER), *lines).alias("prompt"),
    )


def extract_row_values(completions: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, column, predicted) for each column the completion names."""
    found = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                strip(
                    F.nullif(
                        F.regexp_extract("completion", re.escape(c) + r":\s*([^\n]+)", 1), F.lit("")
                    )
                ).alias("predicted"),
            )
            for c in columns
        ]
    )
    return (
        completions.select("row_id", F.explode(found).alias("_f"))
        .select("row_id", "_f.*")
        .where(F.col("predicted").isNotNull())
    )


def held_out_values(table: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, column, actual) in text form."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("actual")) for c in columns]
    )
    return table.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("_c")).select(
        "row_id", "_c.*"
    )


def fuzzy_match(predicted: Column, actual: Column) -> Column:
    """Equal, or one contained in the other, ignoring case and outer whitespace."""
    p, a = strip(F.lower(predicted)), strip(F.lower(actual))
    usable = (F.length(predicted) > 0) & (F.length(actual) > 0)
    return F.coalesce(usable & (F.contains(a, p) | F.contains(p, a)), F.lit(False))


def compare_rows(extracted: DataFrame, actual: DataFrame) -> DataFrame:
    return extracted.join(actual, ["row_id", "column"]).withColumn(
        "is_match", fuzzy_match(F.col("predicted"), F.col("actual"))
    )


def row_accuracy(compared: DataFrame, rows: DataFrame) -> DataFrame:
    """Share of extracted values that match, 0.0 for rows without any."""
    shares = compared.groupBy("row_id").agg(
        F.count("*").alias("extracted"), F.avg(F.col("is_match").cast("double")).alias("accuracy")
    )
    return (
        rows.select("row_id")
        .join(shares, "row_id", "left")
        .select(
            "row_id",
            F.coalesce("extracted", F.lit(0)).alias("extracted"),
            F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        )
    )
