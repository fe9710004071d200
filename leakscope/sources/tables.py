"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, *spread_by: str) -> DataFrame:
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spread(table, *spread_by) if spread_by else table


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Shuffle a table by a unique key, for files of one row group that cannot be split.

    The caller decides; tables of many files need it as little as they can afford it.
    """
    return table.repartition(*keys)


def read_tabular(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header; types are inferred unless a schema is given.

    Inference costs one more pass over the files, so large data should name it.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)
