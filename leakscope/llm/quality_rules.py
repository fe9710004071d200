"""Quality rules: one table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import SPACES, either, let, only, sealed, space_words, text_or_empty

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the four languages.
STOP_WORDS = (
    # English
    "the of and to a in is it that for was on are as with be at by this from or an have not he they which were been has"
    # German
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    # French
    " le la les de des et un une du en est que qui dans pour par sur au avec ne se pas plus ce il sont ou ont aux son"
    # Spanish
    " el los las y que en un una es por con para del se no al lo como su más o pero sus le ha este sí"
).split()


class Rule(NamedTuple):
    """A document breaks the rule where ``measure`` lies outside [least, most].

    A rule with ``from_words`` leaves shorter texts alone.
    """

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("length", "n_words", least=10),
    Rule("word_length", "mean_word_chars", least=2, most=14),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("shouting", "marks_per_word", most=0.4),
    Rule("stop_words", "stop_share", least=0.02, from_words=50),
    Rule("repeated_lines", "dup_line_share", most=0.5),
    Rule("repeated_words", "repeat_share", most=0.2),
)


def _repeated_words(words: Column, count: Column) -> Column:
    """Words inside five-word windows that the text holds twice or more.

    The windows are sorted with their positions, so equal ones are neighbours;
    each repeated window then adds the words the one before it did not cover.
    """
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), count - WINDOW),
            lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("gram"), i.alias("at")),
        )
    )

    def starts(pairs: Column) -> Column:
        def repeated(pair: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
            return F.coalesce(before["gram"] == pair["gram"], F.lit(False)) | F.coalesce(
                after["gram"] == pair["gram"], F.lit(False)
            )

        return F.array_sort(F.transform(F.filter(pairs, repeated), lambda pair: pair["at"]))

    start = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        let(windows, starts),
        start,
        lambda state, at: F.struct(
            (state["covered"] + F.least(F.lit(WINDOW), at - state["last"])).alias("covered"), at.alias("last")
        ),
        lambda state: state["covered"],
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the whole input row) and its measures. A null text counts as empty."""
    split = sealed(docs, text=text_or_empty(F.col(text)))
    split = split.select("row", "text", space_words(F.col("text")).alias("words"))
    count, words = F.size("words"), F.col("words")
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    hashes = F.when(
        count >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), count - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "row",
        "words",
        count.alias("n_words"),
        lines.alias("lines"),
        hashes.alias("hashes"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[!?]")).alias("n_marks"),
        F.size(F.filter("words", lambda word: word.isin(STOP_WORDS))).alias("n_stop_words"),
    )
    # Equal windows have equal hashes, so only texts with equal hashes need the exact count.
    may_repeat = F.size(F.array_distinct("hashes")) < F.size("hashes")
    return counted.select(
        "row",
        F.col("n_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(may_repeat, _repeated_words(F.col("words"), F.col("n_words")))
        .otherwise(0)
        .cast("bigint")
        .alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_marks",
        "n_stop_words",
    )


def _ratios() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "stop_share": F.col("n_stop_words") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
    }


def broken(rule: Rule) -> Column:
    measure = _ratios()[rule.measure]
    bounds = [measure < rule.least] if rule.least is not None else []
    bounds += [measure > rule.most] if rule.most is not None else []
    outside = either(bounds)
    return outside & (F.col("n_words") >= rule.from_words) if rule.from_words else outside


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures and verdict of each document, beside its whole ``row``.

    ``broken`` lists the rules a document breaks, ``base_failed`` says that it has
    fewer than ten words or too many repeated ones, ``kept`` that it breaks none.
    All is one projection without a shuffle. Null and empty texts have no words
    and fail; repeated rows are judged one by one; an empty table gives no rows.
    """
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(broken(rule), F.lit(rule.name)) for rule in rules]))
    judged = measured(docs, text).select(
        "*", base_failed.alias("base_failed"), names.cast("array<string>").alias("broken")
    )
    return judged.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that break no rule, with all their columns."""
    return only(judge(docs, rules, text), F.col("kept"), [F.col("row")]).select("row.*")
