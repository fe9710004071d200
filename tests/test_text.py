import pytest
from pyspark.sql import functions as F

from leakscope.functions import text as fx


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expression.alias("v")).first()["v"]


def test_word_tokens_drop_punctuation_and_keep_accents(spark):
    assert value(spark, fx.word_tokens(F.col("t")), t="L'Été, 2 fois!") == ["l", "été", "2", "fois"]


def test_ngrams_of_short_text_are_empty(spark):
    assert value(spark, fx.ngrams(F.col("w"), 4), w=["a", "b", "c"]) == []
    assert value(spark, fx.ngrams(F.col("w"), 2), w=["a", "b", "c"]) == ["a b", "b c"]


@pytest.mark.parametrize(
    "found, reference, expected",
    [(["a", "b"], ["a"], 1.0), (["a"], ["a", "c"], 0.5), (["a"], [], None)],
)
def test_containment_divides_by_the_reference(spark, found, reference, expected):
    row = spark.createDataFrame([(found, reference)], "f array<string>, r array<string>")
    assert row.select(fx.containment(F.col("f"), F.col("r"))).first()[0] == expected


def test_weighted_jaccard_worked_by_hand(spark):
    row = spark.createDataFrame([("a b c d", "A b c e"), ("", "")], "x string, y string")
    got = [r["s"] for r in fx.weighted_jaccard(row, "x", "y", "s").collect()]
    assert got[0] == pytest.approx(0.2 * 0.6 + 0.3 * 0.5 + 0.5 / 3)
    assert got[1] == 0.0


@pytest.mark.parametrize(
    "reply, letter, strict",
    [("B. because", "B", "B"), ("Answer: B", "A", "B"), ("none", "", ""), ("take C\nnow", "C", "C")],
)
def test_answer_letter(spark, reply, letter, strict):
    assert value(spark, fx.answer_letter(F.col("t")), t=reply) == letter
    assert value(spark, fx.answer_letter(F.col("t"), strict=True), t=reply) == strict


def test_preview_cuts_only_long_texts(spark):
    assert value(spark, fx.preview(F.col("t")), t="x" * 30) == "x" * 30
    assert value(spark, fx.preview(F.col("t")), t="x" * 31) == "x" * 30 + "..."


@pytest.mark.parametrize(
    "left, right, expected",
    [(["a", "b"], ["a", "b"], 2), (["a", "b"], ["a"], 1), (["a"], ["b"], 0), (["a"], ["a", "b"], 1)],
)
def test_common_prefix_length(spark, left, right, expected):
    assert value(spark, fx.common_prefix_length(F.col("l"), F.col("r")), l=left, r=right) == expected
