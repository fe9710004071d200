"""What each method judged by, kept beside its score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import schemas

# An item judged as a whole has no response; its key is this.
WHOLE = ""


def option_detail(options: DataFrame) -> DataFrame:
    """Log-probability of each option in order, and the mean of the wrong ones as baseline.

    ``options``: (item_id, option_idx, correct_idx, logprob), a handful per item.
    """
    wrong = F.col("option_idx") != F.col("correct_idx")
    return options.groupBy("item_id").agg(
        _in_order("option_idx", "logprob")["logprob"].alias("option_logprobs"),
        F.avg(F.when(wrong, F.col("logprob"))).alias("baseline"),
    )


def size_detail(by_size: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest overlap per n-gram size with the number of references it was sought in."""
    sizes = _in_order("n", "references", "max_overlap_ratio")
    return by_size.groupBy("item_id", *keys).agg(sizes.alias("sizes"))


def similarity_detail(similarities: DataFrame, reference: str = "ref_id") -> DataFrame:
    """Similarity to each of an item's references, in the order of the references."""
    listed = _in_order(reference, "similarity")["similarity"]
    return similarities.groupBy("item_id").agg(listed.alias("similarities"))


def trial_detail(mapped: DataFrame) -> DataFrame:
    """Kind, answered letter and original option of each modified prompt."""
    listed = _in_order("trial", "modification_type", "modified_answer", "modified_idx")
    return mapped.groupBy("item_id").agg(listed.alias("trials"))


def method_details(parts: dict[str, DataFrame]) -> DataFrame:
    """(item_id, response_id, method, detail): one typed union over the methods."""
    return reduce(DataFrame.unionByName, [_typed(part, name) for name, part in parts.items()])


def with_detail(per_method: DataFrame, detections: DataFrame, details: DataFrame) -> DataFrame:
    """Each method's detail of its strongest output, with that output's id.

    The strongest has the highest score and, of equals, the greatest id; outputs with
    an error take no part. A method none of whose outputs worked has neither. The other
    outputs' details stay in ``details``, since an item may have any number of them.
    """
    key = F.coalesce("response_id", F.lit(WHOLE))
    worked = detections.where(F.col("memorization_score").isNotNull())
    best = worked.groupBy("item_id", "method").agg(
        F.max_by(key, F.struct(F.col("memorization_score"), key)).alias("_shown")
    )
    found = best.join(
        details.select("item_id", "method", key.alias("_shown"), "detail"), ["item_id", "method", "_shown"], "left"
    )
    return (
        per_method.join(found, ["item_id", "method"], "left")
        .withColumn("shown", F.nullif("_shown", F.lit(WHOLE)))
        .drop("_shown")
    )


def _in_order(*columns: str) -> Column:
    """The columns of a small group's rows as structs, by the first of them."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def _typed(part: DataFrame, method: str) -> DataFrame:
    fields = {
        "option_logprobs": "array<double>",
        "baseline": "double",
        "sizes": schemas.SIZES,
        "similarities": "array<double>",
        "trials": schemas.TRIALS,
    }
    values = [
        (F.col(name) if name in part.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()
    ]
    response = F.col("response_id") if "response_id" in part.columns else F.lit(None)
    return part.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        response.cast("string").alias("response_id"),
        F.lit(method).alias("method"),
        F.struct(*values).alias("detail"),
    )
