"""N-gram containment of benchmark items in a whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.text import word_tokens
from leakscope.operators.scaling import lookup_join
from leakscope.session import stored

# Keeps one gram more where threshold * count is a whole number up to rounding.
ROUNDING = 1e-9
# Over so many tasks the rows of one gram or one item are spread.
SALTS = 16
# A gram travels as two 64-bit hashes, together its identity.
GRAM = ["key", "check"]


def corpus_contamination(
    items: DataFrame,
    corpus: DataFrame,
    n: int = 8,
    threshold: float = config.NGRAM_THRESHOLD,
    item_id: str = "item_id",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pairs (item, document) where the document holds more than ``threshold`` of
    the item's distinct n-grams.

    Grams are ordered from the rarest to the commonest by the documents that hold
    them, alike for items and documents. A pair above the threshold needs ``need``
    grams in common, so its first common one is among the item's rarest, and
    enough grams follow it on either side. Only such grams join; each pair found is
    then counted in full, once. All of it travels as rows of two 64-bit hashes,
    never as strings or lists, and the rows of a hot gram or item are salted. Two
    grams are taken for the same if all 128 bits agree: among 1e13 grams of a
    corpus and 1e7 of the items some such error has a chance of about 3e-19.
    """
    distinct = _grams(items, item_id, text, n).distinct()
    listed = distinct.withColumn("gram_count", F.count("*").over(Window.partitionBy(item_id)).cast("int"))
    wanted = distinct.select(*GRAM).distinct()
    found = _with_salt(_grams(corpus, doc_id, text, n), doc_id).join(
        _salted(wanted), [*GRAM, "_salt"], "left_semi"
    )
    hits = stored(found.select(doc_id, *GRAM).distinct(), "benchmark-grams")
    frequency = hits.groupBy(*GRAM).agg(F.count("*").alias("documents"))
    common = F.col("gram_count") * threshold
    ranked_items = _ranked(listed.join(frequency, GRAM), item_id).withColumn(
        "need", F.floor(common - ROUNDING) + 1
    )
    held = lookup_join(hits, frequency, GRAM, "documents", doc_id, complete=lambda part: part)
    ranked_documents = _ranked(held, doc_id).select(doc_id, *GRAM, F.col("left").alias("doc_left"))
    first = _salted(ranked_items.where(F.col("left") >= F.col("need")).select(item_id, *GRAM, "need"))
    candidates = (
        _with_salt(ranked_documents, doc_id)
        .join(first, [*GRAM, "_salt"])
        .where(F.col("doc_left") >= F.col("need"))
        .select(item_id, doc_id)
        .distinct()
    )
    asked = _with_salt(candidates, doc_id).join(_salted(listed), [item_id, "_salt"])
    return (
        asked.join(hits, [doc_id, *GRAM])
        .groupBy(item_id, doc_id)
        .agg(F.count("*").cast("int").alias("overlap_count"), F.max("gram_count").alias("ref_count"))
        .withColumn("containment", F.col("overlap_count") / F.col("ref_count"))
        .where(F.col("containment") > threshold)
    )


def _grams(texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key column, key, check), one row per gram, repeats included: rows are cheaper to
    make distinct, once few are left, than the elements of a long array of structs."""
    tokens = texts.select(key, word_tokens(F.col(text)).alias("_tokens"))

    def hashed(gram: Column) -> Column:
        return F.struct(F.xxhash64(gram).alias("key"), F.xxhash64(F.lit("check"), gram).alias("check"))

    starts = F.sequence(F.lit(1), F.size("_tokens") - F.lit(n - 1))
    grams = F.transform(F.transform(starts, lambda i: F.slice("_tokens", i, n)), hashed)
    # No filter by size before: it would be pushed below and cut the text into words again.
    exploded = tokens.select(key, F.explode_outer(F.when(F.size("_tokens") >= n, grams)).alias("_gram"))
    return exploded.where(F.col("_gram").isNotNull()).select(key, "_gram.*")


def _ranked(grams: DataFrame, key: str) -> DataFrame:
    """With ``left``: how many grams of the same text come at or after each, rarest first."""
    backwards = Window.partitionBy(key).orderBy(F.desc("documents"), F.desc("key"), F.desc("check"))
    return grams.withColumn("left", F.row_number().over(backwards))


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once per salt; for the side whose size the items bound."""
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_salt(rows: DataFrame, spread: str) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))


def strongest_leak(pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Largest containment any item reaches in a document."""
    return pairs.groupBy(doc_id).agg(F.max("containment").alias("leak_score"))
