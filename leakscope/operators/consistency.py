"""Consistency of answers under reordered and rephrased prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.hashing import pick_of
from leakscope.functions.text import answer_letter, letter_index


def original_answers(items: DataFrame, answer_text: str = "answer_text", strict: bool = False) -> DataFrame:
    """Letter and index of the answer to the unmodified prompt.

    Without a clear letter the index is chosen by the md5 of the item.
    """
    letter = answer_letter(F.col(answer_text), strict)
    arbitrary = pick_of(F.size("options").cast("bigint"), F.col("item_id"), "arbitrary")
    return items.withColumn("original_answer", letter).withColumn(
        "original_idx",
        F.when(F.col("original_answer") != "", letter_index(F.col("original_answer")))
        .when(F.size("options") > 0, arbitrary)
        .cast("int"),
    )


def last_position(options: Column, text: Column) -> Column:
    """Index of the last option equal to the text, null if none is."""
    found = F.array_position(F.reverse(options), text)
    return F.when(found > 0, (F.size(options) - found).cast("int"))


def map_trial_answers(trials: DataFrame, strict: bool = False) -> DataFrame:
    """Answered letter of each trial as an index into the original options, -1 if none.

    ``trials``: (item_id, trial, modification_type, options, options_shown,
    answer_text). With equal option texts the last original one counts.
    """
    letter = answer_letter(F.col("answer_text"), strict)
    index = letter_index(F.col("modified_answer"))
    mapped = last_position(F.col("options"), F.get(F.col("options_shown"), index))
    answered = F.when(F.col("modification_type") == "rephrased", index).otherwise(mapped)
    return trials.withColumn("modified_answer", letter).withColumn(
        "modified_idx",
        F.coalesce(F.when(F.col("modified_answer") != "", answered), F.lit(-1)).cast("int"),
    )


def consistency_score(mapped: DataFrame, originals: DataFrame) -> DataFrame:
    """Share of trials whose answer equals the original one; 0.0 without trials."""
    flags = mapped.select("item_id", "modified_idx").join(
        originals.select("item_id", "original_idx", "correct_idx"), "item_id", "right"
    )
    same = F.col("modified_idx") == F.col("original_idx")
    share = F.avg(F.when(F.col("modified_idx").isNotNull(), F.coalesce(same, F.lit(False)).cast("double")))
    return flags.groupBy("item_id").agg(
        F.count("modified_idx").alias("trials"),
        F.count_if(same).alias("consistent"),
        F.coalesce(share, F.lit(0.0)).alias("consistency_score"),
        F.max("original_idx").alias("original_idx"),
        F.max("correct_idx").alias("correct_idx"),
    )


def consistency_verdict(
    scored: DataFrame, threshold: float = config.CONSISTENCY_THRESHOLD
) -> DataFrame:
    """Right at first but unstable afterwards suggests memorization."""
    correct = F.coalesce(F.col("original_idx") == F.col("correct_idx"), F.lit(False))
    return (
        scored.withColumn("original_correct", correct)
        .withColumn(
            "memorization_score",
            F.when(F.col("original_correct"), 1.0 - F.col("consistency_score")).otherwise(0.0),
        )
        .withColumn(
            "is_memorized", F.col("original_correct") & (F.col("consistency_score") < threshold)
        )
        .withColumn("threshold", F.lit(threshold))
    )
