"""Similarity of two texts by the character pairs they share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope import config


def held(value: Column, use) -> Column:
    """use(value) with the value worked out once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def character_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; empty for shorter texts.

    The text is cut into characters once, so the work grows with its length.
    """

    def pairs(chars: Column) -> Column:
        count = F.size(chars) - 1
        return F.array_distinct(F.zip_with(F.slice(chars, 1, count), F.slice(chars, 2, count), lambda a, b: F.concat(a, b)))

    # A text of n characters is cut into n pieces; the limit keeps an empty last one away.
    cut = F.slice(F.split(text, ""), 1, F.greatest(F.length(text), F.lit(1)))
    return F.when(F.length(text) >= 2, held(cut, pairs)).otherwise(F.array().cast("array<string>"))


def share_of_pairs(left_pairs: Column, right_pairs: Column, equal: Column) -> Column:
    """Dice share of the common pairs; without any pairs 1 if the texts are equal, else 0."""

    def share(both: Column) -> Column:
        a, b = both["a"], both["b"]
        total = F.size(a) + F.size(b)
        common = F.try_divide(2.0 * F.size(F.array_intersect(a, b)), total.cast("double"))
        return F.when(total > 0, common).otherwise(F.when(equal, F.lit(1.0)).otherwise(F.lit(0.0)))

    return held(F.struct(left_pairs.alias("a"), right_pairs.alias("b")), share)


def pair_similarity(left: Column, right: Column) -> Column:
    """Dice share of the common pairs; texts without pairs are alike if equal. Null if one is null.

    Linear in the texts and evaluated in the JVM. Where one text meets many, work out
    its :func:`character_pairs` once and call :func:`share_of_pairs`.
    """
    share = share_of_pairs(character_pairs(left), character_pairs(right), left == right)
    return F.when(left.isNull() | right.isNull(), F.lit(None)).otherwise(share)


def closest_option(options: Column, answer: Column, cutoff: float = config.ANSWER_MATCH_CUTOFF) -> Column:
    """Index of the first option most like the answer, null below the cutoff."""
    scored = F.transform(
        options, lambda o, i: F.struct(F.coalesce(pair_similarity(o, answer), F.lit(-1.0)).alias("score"), (-i).alias("minus"))
    )
    best = F.array_max(scored)
    return F.when(best["score"] >= cutoff, -best["minus"])
