"""Helpers of the training-data operators: words, safe rows, lookups of hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.operators.scaling import probably_in  # noqa: F401
from leakscope.session import stored

# A word is a run of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
LAST_ID = 2**63 - 1


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def space_words(text: Column) -> Column:
    """Whitespace-separated words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    nothing = F.array().cast("array<string>")
    return F.when(F.length(trimmed) == 0, nothing).otherwise(F.split(trimmed, SPACE))


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sealed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one column ``row`` beside the named ones.

    Working columns then never clash with columns of the input; ``row.*`` gives
    the input back.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def only(table: DataFrame, condition: Column, columns: list) -> DataFrame:
    """The columns of the rows where the condition holds.

    Both are worked out once, in the rows' own projection. A filter would be pushed
    below that, and would repeat its expressions, even inside the lambdas that use them.
    """
    row = F.struct(condition.alias("holds"), F.struct(*columns).alias("row"))
    return table.select(F.explode(F.filter(F.array(row), lambda r: r["holds"])).alias("found")).select("found.row.*")


def either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def once(table: DataFrame, name: str) -> DataFrame:
    """Written to the cluster's shared folder and read back."""
    return stored(table, f"llm-{name}")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and root, the smallest node of its connected component.

    ``edges`` has the columns a and b. Each round every node takes its smallest
    neighbour as parent and the edges shrink to those between parents; a star
    ends after one round, a path after about the logarithm of its length.
    """
    rounds = []
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        parents = once(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("parent")),
            f"{name}-parents",
        )
        rounds.append(parents)
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        rest = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        edges = once(
            rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges"
        )
        if edges.isEmpty():
            break
    found = rounds.pop().select("node", F.col("parent").alias("root"))
    while rounds:
        above = found.select(F.col("node").alias("parent"), "root")
        found = once(
            rounds.pop().join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")),
            f"{name}-roots",
        )
    return found
