"""Deterministic choices: every "random" decision is an md5 of its own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[_as_string(p) for p in parts]))


def pick(choices: int, *parts) -> Column:
    """A number in [0, choices) chosen by the md5 of the parts."""
    head = F.substring(hash_key(*parts), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(choices)


def pick_of(choices, *parts) -> Column:
    """A number in [0, choices) where the number of choices is a column."""
    head = F.substring(hash_key(*parts), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % choices


def shuffled_positions(count: Column, *parts) -> Column:
    """Positions 0..count-1 in md5 order, never the identity if count > 1."""
    positions = F.sequence(F.lit(0), count - 1)
    keyed = F.array_sort(
        F.transform(positions, lambda i: F.struct(hash_key(*parts, i).alias("k"), i.alias("i")))
    )
    order = F.transform(keyed, lambda s: s["i"])
    rotated = F.concat(F.slice(order, 2, count - 1), F.slice(order, 1, 1))
    return F.when(count < 2, positions).otherwise(
        F.when(order == positions, rotated).otherwise(order)
    )


def _as_string(part) -> Column:
    column = F.lit(part) if isinstance(part, (str, int)) else part
    return column.cast("string")
