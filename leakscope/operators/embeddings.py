"""Cosine similarity of vectors, text vectors and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.text import explode_rows, word_tokens
from leakscope.functions.vectors import EPSILON, as_doubles, cosine, norm

# Most rows of a block, and the query rows compared at once: the similarities stay near 70 MB.
BLOCK_ROWS = 16384
STRIP_ROWS = 512
# Smaller tables are cut into up to so many blocks of an eighth, so that they spread too.
LEAST_BLOCKS = 8
# A term above this share of all occurrences is broadcast, so at most 100,000 are.
COMMON_SHARE = 1e-5


def with_norms(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors as doubles with their norm, both computed once per vector."""
    doubles = vectors.withColumn(vector, as_doubles(F.col(vector)))
    return doubles.withColumn("norm", norm(F.col(vector)))


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, left: str, right: str) -> DataFrame:
    """Cosine for each listed pair of vector ids."""
    stored = with_norms(vectors.select("vec_id", "embedding"))
    a = stored.select(
        F.col("vec_id").alias(left), F.col("embedding").alias("_a"), F.col("norm").alias("_na")
    )
    b = stored.select(
        F.col("vec_id").alias(right), F.col("embedding").alias("_b"), F.col("norm").alias("_nb")
    )
    value = cosine(F.col("_a"), F.col("_b"), F.col("_na"), F.col("_nb"))
    return (
        pairs.join(a, left)
        .join(b, right)
        .withColumn("similarity", value)
        .drop("_a", "_b", "_na", "_nb")
    )


def embedding_verdict(
    similarities: DataFrame, threshold: float = config.EMBEDDING_THRESHOLD, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Largest similarity of an output over its item's references; without any 0.0.

    ``similarities``: (item_id, keys, similarity), null where there is no reference.
    """
    return (
        similarities.groupBy("item_id", *keys)
        .agg(
            F.count("similarity").alias("references"),
            F.coalesce(F.max("similarity"), F.lit(0.0)).alias("memorization_score"),
        )
        .withColumn("is_memorized", F.col("memorization_score") > threshold)
        .withColumn("threshold", F.lit(threshold))
    )


def term_rows(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """(text_id, term, tf), with all rows of an id in one task: the texts travel, their terms do not."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_id = texts.select(text_id, text).repartition(tasks, text_id)
    words = explode_rows(by_id, word_tokens(F.col(text)), "term", text_id)
    return words.groupBy(text_id, "term").agg(F.count("*").alias("tf"))


def text_vectors(
    texts: DataFrame,
    text_id: str,
    text: str,
    corpus: DataFrame | None = None,
    corpus_text: str = "text",
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """Unit-length TF-IDF vectors in sparse long form: (text_id, term, weight).

    The inverse document frequency is ``ln((N + 1) / (df + 1))`` over ``corpus``,
    by default the texts themselves. Common terms, of more than ``common_share`` of
    all occurrences and so at most its inverse, are broadcast to the texts; rare ones
    go to the dictionary and come back. A text's own terms are brought together to
    scale them; they fit where the text did.
    """
    if corpus is None:
        corpus, corpus_text = texts, text
    documents = corpus.agg(F.count("*")).scalar()
    distinct = F.array_distinct(word_tokens(F.col(corpus_text)))
    frequency = explode_rows(corpus, distinct, "term").groupBy("term").agg(F.count("*").alias("df"))
    dictionary = frequency.withColumn("idf", F.ln((documents + 1) / (F.col("df") + 1)))
    limit = frequency.agg(F.sum("df")).scalar() * F.lit(common_share)
    common = dictionary.where(F.col("df") > limit).select("term", "idf")
    rare = dictionary.where(F.col("df") <= limit).select("term", "idf")

    def gathered(terms: DataFrame, name: str) -> DataFrame:
        raw = F.col("tf") * F.col("idf")
        return terms.groupBy("_of").agg(
            F.collect_list(F.when(raw.isNotNull(), F.struct("term", raw.alias("raw")))).alias(f"_{name}"),
            F.sum(raw * raw).alias(f"_{name}_squares"),
        )

    # Within a struct, an id that is null equals itself.
    keyed = texts.select(F.struct(F.col(text_id).alias("id")).alias("_of"), F.col(text).alias("_text"))
    marked = term_rows(keyed, "_of", "_text").join(F.broadcast(common), "term", "left")
    asked = marked.where("idf IS NULL").drop("idf").join(rare, "term", "left")
    answered = asked.withColumn("idf", F.coalesce("idf", F.ln(documents + 1)))
    both = gathered(marked, "common").join(gathered(answered, "rare"), "_of", "left")
    nothing = F.array().cast("array<struct<term:string,raw:double>>")
    squares = F.coalesce("_common_squares", F.lit(0.0)) + F.coalesce("_rare_squares", F.lit(0.0))
    return (
        both.withColumn("_length", F.sqrt(squares))
        .where(F.col("_length") > 0)
        .select("_of", "_length", F.explode(F.concat("_common", F.coalesce("_rare", nothing))).alias("_t"))
        .select(F.col("_of.id").alias(text_id), "_t.term", (F.col("_t.raw") / F.col("_length")).alias("weight"))
    )


def sparse_similarity(
    left: DataFrame, right: DataFrame, key: str, ref: str, outputs: tuple[str, ...] = ()
) -> DataFrame:
    """Cosine of unit sparse vectors for outputs and their item's references.

    ``left``: (key, outputs, term, weight), where the outputs' columns tell those of a
    key apart; ``right``: (key, ref, term, weight). The key is part of the join, so
    common terms do not pair up across items.
    """
    other = right.withColumnRenamed("weight", "_w")
    product = F.sum(F.col("weight") * F.col("_w"))
    return left.join(other, [key, "term"]).groupBy(key, *outputs, ref).agg(product.alias("similarity"))


def nearest_vectors(
    queries: DataFrame,
    references: DataFrame,
    k: int = 5,
    exclude_same_id: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k references of largest cosine for each query, exactly.

    Both sides, (vec_id, embedding), are hashed into blocks of bounded size.
    Every pair of blocks is compared by matrix products of strips of its queries and
    emits at most k rows per query; the partial lists are then merged. A vector travels
    once per block of the other side, as it is stored. Similarities are compared at six
    decimals, ties go to the smaller id.
    """
    query_blocks, reference_blocks = _block_count(queries, block_rows), _block_count(references, block_rows)
    left = _replicated(queries, "qb", query_blocks, "rb", reference_blocks)
    right = _replicated(references, "rb", reference_blocks, "qb", query_blocks)

    def cell(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return _cell_top(q, r, k, exclude_same_id)

    partial = (
        left.groupBy("qb", "rb")
        .cogroup(right.groupBy("qb", "rb"))
        .applyInPandas(cell, "vec_id bigint, neighbour_id bigint, similarity double")
    )
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_count(vectors: DataFrame, block_rows: int) -> Column:
    """A scalar subquery, so that building the plan runs no job."""
    small = F.least(F.ceil(F.count("*") / max(block_rows // 8, 1)), F.lit(LEAST_BLOCKS))
    return vectors.agg(F.greatest(F.ceil(F.count("*") / block_rows), small, F.lit(1)).cast("int")).scalar()


def _replicated(vectors: DataFrame, own: str, blocks: Column, other: str, copies: Column) -> DataFrame:
    embedding = F.col("embedding")
    as_stored = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    return vectors.select(
        "vec_id",
        (embedding if as_stored else as_doubles(embedding)).alias("embedding"),
        F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), copies - 1)).alias(other),
    )


def _unit_matrix(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    lengths = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), EPSILON)
    return matrix / lengths


def _cell_top(q: pd.DataFrame, r: pd.DataFrame, k: int, exclude_same_id: bool) -> pd.DataFrame:
    columns = ["vec_id", "neighbour_id", "similarity"]
    if q.empty or r.empty:
        return pd.DataFrame({c: [] for c in columns})
    r = r.sort_values("vec_id")
    query_ids, ids = q["vec_id"].to_numpy(), r["vec_id"].to_numpy()
    left, right = _unit_matrix(q["embedding"]), _unit_matrix(r["embedding"])
    parts = []
    for start in range(0, len(query_ids), STRIP_ROWS):
        asked = query_ids[start : start + STRIP_ROWS]
        scores = np.round(left[start : start + STRIP_ROWS] @ right.T, 6)
        scores[np.isnan(scores)] = -np.inf  # a vector with NaN is nobody's neighbour
        if exclude_same_id:
            scores[asked[:, None] == ids[None, :]] = -np.inf
        parts += _top_rows(asked, ids, scores, min(k, len(ids)))
    return pd.DataFrame(
        {name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(columns)}
    )


def _top_rows(
    query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for query, row in zip(query_ids, scores):
        floor = np.partition(row, len(row) - k)[len(row) - k]
        kept = np.flatnonzero((row >= floor) & np.isfinite(row))
        best = kept[np.argsort(-row[kept], kind="stable")][:k]
        yield np.full(len(best), query), ids[best], row[best]


def unusual_neighbours(neighbours: DataFrame, threshold: float = config.EMBEDDING_THRESHOLD) -> DataFrame:
    return neighbours.withColumn("is_unusual", F.col("similarity") > threshold)
