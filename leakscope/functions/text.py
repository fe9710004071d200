"""Token, n-gram and text-similarity expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import config

WORD = r"[\p{L}\p{N}]+"
WHITESPACE = " \t\n\r\f\u000b"


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; punctuation is not a token."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def cased_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased words between whitespace."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))


def strip(text: Column) -> Column:
    """Remove whitespace, not only blanks, at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array, in order; empty if the text is too short.

    ``tokens`` must be a stored column: it is read once per n-gram.
    """
    count = F.size(tokens) - F.lit(n - 1)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.array_join(F.slice(tokens, i, n), " "),
    )
    return F.when(count >= 1, grams).otherwise(F.lit([]).cast("array<string>"))


def ngram_set(tokens: Column, n: int) -> Column:
    return F.array_distinct(ngrams(tokens, n))


def containment(found: Column, reference: Column) -> Column:
    """Share of the reference set found in the other; null if it is empty."""
    overlap = F.size(F.array_intersect(found, reference)).cast("double")
    return F.when(F.size(reference) > 0, overlap / F.size(reference))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0.0 if both are empty."""
    both = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - both
    return F.when(union > 0, both.cast("double") / union).otherwise(F.lit(0.0))


def weighted_jaccard(df: DataFrame, left: str, right: str, alias: str) -> DataFrame:
    """Weighted mean of the 1-, 2- and 3-gram Jaccard similarity of two texts."""
    tokens = df.withColumns(
        {
            "_left": whitespace_tokens(F.col(left)),
            "_right": whitespace_tokens(F.col(right)),
        }
    )
    sizes = range(1, len(config.JACCARD_WEIGHTS) + 1)
    sets = tokens.withColumns(
        {f"{side}{n}": ngram_set(F.col(side), n) for side in ("_left", "_right") for n in sizes}
    )
    score = F.lit(0.0)
    for n, weight in zip(sizes, config.JACCARD_WEIGHTS):
        score = score + jaccard(F.col(f"_left{n}"), F.col(f"_right{n}")) * F.lit(weight)
    return sets.withColumn(alias, score).select(*df.columns, alias)


def preview(text: Column, chars: int = config.PREVIEW_CHARS) -> Column:
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def answer_letter(text: Column, strict: bool = False) -> Column:
    """Answer letter A-D of a free-text reply, '' if there is none.

    By default a letter before a full stop or whitespace wins, then the first
    letter anywhere. ``strict`` accepts only a letter that stands alone.
    """
    if strict:
        return F.regexp_extract(text, r"\b([A-D])\b", 1)
    marked = F.regexp_extract(text, r"([A-D])[.\s]", 1)
    anywhere = F.regexp_extract(text, r"[A-D]", 0)
    return F.coalesce(F.nullif(marked, F.lit("")), anywhere)


def letter_index(letter: Column) -> Column:
    return F.ascii(letter) - F.lit(ord("A"))


def index_letter(index: Column) -> Column:
    return F.char((index + F.lit(ord("A"))).cast("bigint"))


def common_prefix_length(left: Column, right: Column) -> Column:
    """Number of leading elements two arrays share."""
    same = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    mismatch = F.array_position(same, False)
    return F.when(mismatch == 0, F.size(left)).otherwise((mismatch - 1).cast("int"))


def explode_rows(df: DataFrame, array: Column, alias: str, *keep) -> DataFrame:
    """One row per array element, beside the kept columns.

    The outer form spares the optimizer's inferred size check, which would
    evaluate the array expression a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(alias)).where(F.col(alias).isNotNull())
