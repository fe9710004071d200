"""N-gram overlap of a text with its own references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.text import ngram_set, word_tokens


def own_references(items: DataFrame, with_question: bool = True) -> DataFrame:
    """(item_id, ref_idx, reference): the question, then each option."""
    options = F.col("options")
    texts = F.concat(F.array("question"), options) if with_question else options
    return items.select("item_id", F.posexplode(texts).alias("ref_idx", "reference"))


def ngram_overlap(
    outputs: DataFrame,
    references: DataFrame,
    text: str = "completion",
    sizes: tuple[int, ...] = config.NGRAM_SIZES,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Overlap of each output with each of its item's references, per n-gram size.

    ``outputs``: (item_id, keys, text), where the keys tell the outputs of an item
    apart; ``references``: (item_id, ref_idx, reference). Both sides are tokenised
    once, before the sizes multiply the rows. A reference too short for an n-gram
    keeps a row with a null ratio.
    """
    left = _gram_sets(outputs.select("item_id", *keys, F.col(text).alias("_text")), "_found", sizes)
    right = _gram_sets(
        references.select("item_id", "ref_idx", F.col("reference").alias("_text")),
        "_reference",
        sizes,
    )
    per_size = F.array(
        *[
            F.struct(
                F.lit(n).alias("n"),
                F.size(f"_found{n}").alias("output_count"),
                F.size(f"_reference{n}").alias("ref_count"),
                F.size(F.array_intersect(f"_found{n}", f"_reference{n}")).alias("overlap_count"),
            )
            for n in sizes
        ]
    )
    rows = (
        left.join(right, "item_id")
        .select("item_id", *keys, "ref_idx", F.explode(per_size).alias("_o"))
        .select("item_id", *keys, "ref_idx", "_o.*")
    )
    return rows.withColumn(
        "overlap_ratio",
        F.when(F.col("ref_count") > 0, F.col("overlap_count") / F.col("ref_count")),
    )


def _gram_sets(texts: DataFrame, prefix: str, sizes: tuple[int, ...]) -> DataFrame:
    tokens = texts.withColumn("_tokens", word_tokens(F.col("_text")))
    sets = {f"{prefix}{n}": ngram_set(F.col("_tokens"), n) for n in sizes}
    return tokens.withColumns(sets).drop("_text", "_tokens")


def ngram_by_size(overlaps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest ratio of an output over the references of its item, per n-gram size."""
    return overlaps.groupBy("item_id", *keys, "n").agg(
        F.max("output_count").alias("output_count"),
        F.count("overlap_ratio").alias("references"),
        F.coalesce(F.max("overlap_ratio"), F.lit(0.0)).alias("max_overlap_ratio"),
    )


def ngram_verdict(
    by_size: DataFrame, threshold: float = config.NGRAM_THRESHOLD, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Largest ratio of an output over all sizes, memorized above the threshold."""
    return (
        by_size.groupBy("item_id", *keys)
        .agg(F.max("max_overlap_ratio").alias("memorization_score"))
        .withColumn("is_memorized", F.col("memorization_score") > threshold)
        .withColumn("threshold", F.lit(threshold))
    )
