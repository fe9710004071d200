"""Token counts kept as rollups of signed changes, committed batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm.common import space_words

KEYS = ("source", "lang", "tokenizer")
_RUN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]"
_SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"


def count_words(text: Column) -> Column:
    """Version ``words_1``: words between white space."""
    return F.size(space_words(text)).cast("bigint")


def count_runs(text: Column) -> Column:
    """Version ``runs_1``: runs of letters, runs of digits, and every other character."""
    return F.regexp_count(text, F.lit(_RUN)).cast("bigint")


TOKENIZERS = {"words_1": count_words, "runs_1": count_runs}


def changes(counts: DataFrame, tokenizer: str, tokens: str, sign: int = 1, docs: int | None = None) -> DataFrame:
    """Signed changes of counted documents: 1 puts them in, -1 takes them out.

    ``docs=0`` changes tokens only. A null count adds no tokens.
    """
    return counts.select(
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign if docs is None else docs).cast("bigint").alias("n_docs"),
        (F.lit(sign) * F.coalesce(tokens, F.lit(0))).cast("bigint").alias("n_tokens"),
    )


def revisions(counts: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Changes of documents whose count is now another; their number stays."""
    return changes(counts, tokenizer, old, -1, docs=0).union(changes(counts, tokenizer, new, 1, docs=0))


def commit(batch: DataFrame, root: str, batch_id: str) -> None:
    """Write the summed changes of a batch under its id.

    A batch that comes again, or failed half way, replaces what its id wrote, so it
    counts once. Only sums per source, language and tokenizer are written; they are
    combined before the shuffle, so one hot source costs a row per task.
    """
    sums = batch.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches.

    Null sources and languages are groups of their own. Groups without documents
    and tokens are left out. Before the first commit there are no rows to read,
    so at least one batch, which may be empty, must be committed.
    """
    batches = spark.read.schema(_SCHEMA).parquet(root)
    sums = batches.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 OR n_tokens <> 0")


def compact(spark: SparkSession, root: str, to: str) -> None:
    """One batch ``base`` with the totals so far, in a new folder for later commits."""
    commit(totals(spark, root), to, "base")


def without_repeated_lines(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


