"""Rows and tables with every awkward case, shared by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the quick brown fox jumps over a lazy dog and then it runs home to sleep".split()


def documents(spark, rows):
    """rows of (doc_id, text); extra columns carry names that operators use inside."""
    table = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
    clashing = "row words lines doc key h1 tid path order position n kept broken start length tokens _salt".split()
    return table.withColumns({c: F.lit(f"own {c}") for c in clashing})


def awkward():
    long = " ".join(f"{w}{i}" for i in range(6000) for w in ("ab", "cd"))
    plain = " ".join(WORDS)
    return [(1, plain), (1, plain), (2, None), (3, ""), (None, plain), (4, long), (5, " \n\t"), (6, plain + "\n" + plain), (None, None)]
