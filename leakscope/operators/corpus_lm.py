"""Token log-probabilities without a model call: rules, or a counted bigram model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope import config
from leakscope.functions.text import word_tokens
from leakscope.operators.scaling import HOT_SHARE, SALTS, lookup_join, probably_in
from leakscope.session import stored


def rule_logprob(token: Column) -> Column:
    """Common words, and a blank by itself, are likelier than all others.

    Tokens are compared as they are: a word with a blank before it is another one.
    """
    common = F.lower(token).isin(*config.COMMON_WORDS)
    return F.when(common, F.lit(config.COMMON_LOGPROB)).otherwise(F.lit(config.OTHER_LOGPROB))


def rule_logprob_by_class(token: Column) -> Column:
    """Three classes of words, each at the midpoint of its range.

    The token without the white space around it is compared as it is written, so a
    capital makes another word.
    """
    word = F.btrim(token, F.lit(" \t\n\x0b\f\r"))
    return (
        F.when(word.isin(*config.FREQUENT_WORDS), F.lit(sum(config.FREQUENT_RANGE) / 2))
        .when(word.isin(*config.FACT_WORDS), F.lit(sum(config.FACT_RANGE) / 2))
        .otherwise(F.lit(sum(config.OTHER_RANGE) / 2))
    )


def token_rows(sequences: DataFrame, seq_id: str, tokens: Column) -> DataFrame:
    """(seq_id, pos, prev, token) of token arrays; prev is null at position 0."""
    stored_tokens = sequences.select(seq_id, tokens.alias("_tokens"))
    before = F.concat(F.array(F.lit(None)), F.col("_tokens"))
    linked = F.arrays_zip(before.alias("prev"), F.col("_tokens").alias("token"))
    exploded = stored_tokens.select(seq_id, F.posexplode_outer(linked).alias("pos", "_t"))
    return exploded.where(F.col("_t.token").isNotNull()).select(seq_id, "pos", "_t.prev", "_t.token")


def text_token_rows(texts: DataFrame, seq_id: str, text: str) -> DataFrame:
    return token_rows(texts, seq_id, word_tokens(F.col(text)))


def word_hashes(text: Column) -> Column:
    """The words of a text as 64-bit hashes: rows and joins of them are slim.

    Two words of equal hash would count as one, which among ten million words happens
    with a chance of three in a million.
    """
    return F.transform(word_tokens(text), lambda word: F.xxhash64(word))


def score_tokens(rows: DataFrame, corpus: DataFrame, text: str, seq_id: str, hashed: bool = False) -> DataFrame:
    """Add-one bigram log-probabilities of rows, counted on a larger corpus.

    The corpus pass counts words, and beside them the pairs that the scored rows ask
    for (and few others, let through by a filter of fixed size), combined per task before
    they are shuffled, so a frequent word costs one row per task. With ``hashed`` the
    rows hold :func:`word_hashes`.
    """
    needed = stored(_scored_pairs(rows), "scored-pairs")
    words = word_hashes if hashed else word_tokens
    corpus_words = token_rows(corpus.withColumn("_id", F.lit(0)), "_id", words(F.col(text)))
    asked = probably_in(needed.select(F.xxhash64("prev", "token").alias("pair")), "pair")(F.xxhash64("prev", "token"))
    counted = stored(
        corpus_words.select(F.when(asked, F.col("prev")).alias("prev"), "token")
        .groupBy("prev", "token")
        .agg(F.count("*").alias("pair_count")),
        "pair-counts",
    )
    pairs = needed.join(counted, ["prev", "token"], "left")
    return _score(rows, pairs, _word_counts(counted), seq_id)


def score_own_tokens(rows: DataFrame, seq_id: str, in_model: str) -> DataFrame:
    """The same where the corpus is part of the scored rows, marked by ``in_model``.

    The rows are read several times, so their words should be stored. They are shuffled
    once, by their first word: its count is joined there, and those of its pairs are sums
    over the rows beside. The rows of a hot word are spread by the second one; those of
    hot pairs, whose words are both hot, and those without a first word by ``seq_id``. Hot
    words and pairs, at most a thousand each, are counted before and broadcast.
    """
    words = stored(
        rows.groupBy(F.col("token").alias("prev")).agg(
            F.count("*").alias("occurrences"), F.count_if(in_model).alias("prev_count")
        ),
        "word-counts",
    )
    vocabulary = words.agg(F.count_if(F.col("prev_count") > 0)).scalar()
    limit = words.agg(F.sum("occurrences")).scalar() * F.lit(HOT_SHARE)
    is_hot = F.col("occurrences") > limit
    hot = words.where(is_hot)
    both_hot = rows.join(F.broadcast(hot.select("prev")), "prev").join(
        F.broadcast(hot.select(F.col("prev").alias("token"))), "token"
    )
    hot_pairs = stored(
        both_hot.groupBy("prev", "token")
        .agg(F.count("*").alias("occurrences"), F.count_if(in_model).alias("_pair_count"))
        .where(is_hot)
        .select("prev", "token", "_pair_count"),
        "hot-pairs",
    )
    spread = F.when(F.col("_pair_count").isNotNull() | F.col("prev").isNull(), F.xxhash64(seq_id)).when(
        F.col("_hot").isNotNull(), F.xxhash64("token")
    )
    salted = (
        rows.join(F.broadcast(hot.select("prev", F.col("prev_count").alias("_hot"))), "prev", "left")
        .join(F.broadcast(hot_pairs), ["prev", "token"], "left")
        .withColumn("_salt", F.coalesce(1 + F.pmod(spread, F.lit(SALTS)), F.lit(0)).cast("int"))
    )
    cold = words.where(~is_hot).select("prev", F.lit(0).alias("_salt"), F.col("prev_count").alias("_cold"))
    counted = salted.join(cold, ["prev", "_salt"], "left")
    beside = F.count_if(in_model).over(Window.partitionBy("prev", "_salt", "token"))
    seen = F.coalesce("_pair_count", beside) + 1
    context = F.coalesce("_hot", "_cold", F.lit(0)) + vocabulary
    logprob = F.when(F.col("prev").isNotNull(), F.ln(seen / context))
    return counted.select(*rows.columns, logprob.alias("logprob"))


def _scored_pairs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("prev").isNotNull()).groupBy("prev", "token").agg(
        F.count("*").alias("occurrences")
    )


def _word_counts(counted: DataFrame) -> DataFrame:
    """(prev, prev_count): how often each word of the corpus occurs."""
    words = counted.groupBy(F.col("token").alias("prev")).agg(F.sum("pair_count").alias("prev_count"))
    return words.where(F.col("prev_count") > 0)


def _score(rows: DataFrame, pairs: DataFrame, words: DataFrame, seq_id: str) -> DataFrame:
    vocabulary = words.agg(F.count("*")).scalar()

    def with_logprob(part: DataFrame) -> DataFrame:
        seen = F.coalesce("pair_count", F.lit(0)) + 1
        context = F.coalesce("prev_count", F.lit(0)) + vocabulary
        return part.join(words, ["prev"], "left").select(
            "prev", "token", F.ln(seen / context).alias("logprob")
        )

    return lookup_join(rows, pairs, ["prev", "token"], "occurrences", seq_id, with_logprob)
