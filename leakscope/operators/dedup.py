"""Exact duplicates of training texts and their effect on leak scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.text import WHITESPACE


def text_key(text: Column) -> Column:
    """Digest of the text, ignoring case and the amount of whitespace."""
    folded = F.regexp_replace(F.btrim(F.lower(text), F.lit(WHITESPACE)), r"\s+", " ")
    return F.md5(folded)


def duplicate_counts(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Number of copies per distinct text, with the first id.

    Only digests and ids are shuffled, already combined per task, so a text with
    very many copies costs one row per task.
    """
    return texts.groupBy(text_key(F.col(text)).alias("text_key")).agg(
        F.count("*").alias("copies"), F.min(text_id).alias("first_id")
    )


def exact_dedup(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """The first text of each group of copies."""
    first = duplicate_counts(texts, text_id, text).select(F.col("first_id").alias(text_id))
    return texts.join(first, text_id, "left_semi")


def score_by_duplication(texts: DataFrame, scores: DataFrame, text_id: str, text: str) -> DataFrame:
    """Mean score per power-of-two band of the number of copies.

    Scores join by text id, which is unique; the copies only meet in a grouping
    that is combined per task first.
    """
    scored = texts.select(text_id, text_key(F.col(text)).alias("text_key")).join(
        scores, text_id, "left"
    )
    groups = scored.groupBy("text_key").agg(
        F.count("*").alias("copies"),
        F.sum(F.coalesce("leak_score", F.lit(0.0))).alias("score_sum"),
    )
    band = F.floor(F.log2("copies"))
    return groups.groupBy(band.alias("copies_band")).agg(
        F.count("*").alias("distinct_texts"),
        F.sum("copies").alias("texts"),
        (F.sum("score_sum") / F.sum("copies")).alias("avg_score"),
    )
