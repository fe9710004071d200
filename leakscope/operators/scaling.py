"""Joins and running sums that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key above this share of all rows is hot, so there are at most 1,000 hot keys.
HOT_SHARE = 0.001
SALTS = 4096
# Bits of a filter's bitmap: 2 MB, however many keys it marks.
FILTER_BITS = 2**24
CHUNK_ROWS = 100_000


def lookup_join(
    rows: DataFrame,
    dictionary: DataFrame,
    keys: list[str],
    occurrences: str,
    spread: str,
    complete: Callable[[DataFrame], DataFrame] | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Left join of rows with a dictionary that has one entry per key.

    ``occurrences`` counts the rows per key. The hot keys, at most
    ``1 / hot_share`` by arithmetic, are broadcast; their rows then travel to the
    second join under salted keys that match nothing there, spread by ``spread``.
    ``complete`` adds the values to either part of the dictionary, so costly
    ones are not worked out just to find the hot keys.
    """
    limit = dictionary.agg(F.sum(occurrences)).scalar() * F.lit(hot_share)
    is_hot = F.col(occurrences) > limit
    complete = complete or (lambda part: part.drop(occurrences))
    hot, cold = complete(dictionary.where(is_hot)), complete(dictionary.where(~is_hot))
    values = [c for c in hot.columns if c not in keys]
    entry = F.struct(*values)
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(
        1 + F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    )
    found = (
        rows.join(F.broadcast(hot.select(*keys, entry.alias("_hot"))), keys, "left")
        .withColumn("_salt", salt)
        .join(
            cold.select(*keys, F.lit(0).alias("_salt"), entry.alias("_cold")), [*keys, "_salt"], "left"
        )
        .withColumn("_entry", F.coalesce("_hot", "_cold"))
    )
    return found.select(*rows.columns, *[F.col(f"_entry.{v}").alias(v) for v in values])


def probably_in(keys: DataFrame, column: str):
    """A test that no key of the table fails, and few others pass while the keys are few.

    For rows to be left out before a join shuffles them; the join then decides. The
    keys' hashes are gathered as a bitmap of fixed size, a scalar subquery that all
    tasks read. Returns a function from a key column to a condition.
    """

    def place(key: Column) -> Column:
        return F.xxhash64(key).bitwiseAND(F.lit(FILTER_BITS - 1))

    def bit(key: Column) -> Column:
        return place(key).bitwiseAND(F.lit(63)).cast("int")

    words = keys.groupBy(F.shiftright(place(F.col(column)), 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col(column)))).alias("bits")
    )
    every = keys.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left")
    numbers = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    bitmap = every.agg(F.transform(numbers, lambda n: n["bits"])).scalar()

    def test(key: Column) -> Column:
        word = F.get(bitmap, F.shiftright(place(key), 6).cast("int"))
        return F.call_function("shiftright", word, bit(key)).bitwiseAND(F.lit(1)) == 1

    return test


def running_sums(
    rows: DataFrame,
    key: str,
    position: str,
    values: dict[str, Column],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sums of each value up to and including the position, per key.

    A sequence is cut into chunks of positions; the chunk totals give every
    chunk its starting value, so no task ever holds more than one chunk of a
    long sequence. All steps share the one partitioning by (key, chunk).
    """
    chunked = (
        rows.withColumn("_chunk", F.floor(F.col(position) / chunk_rows))
        .withColumns({f"_v_{name}": value for name, value in values.items()})
        .repartition(key, "_chunk")
    )
    totals = chunked.groupBy(key, "_chunk").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values]
    )
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        key, "_chunk", *[F.sum(f"_t_{name}").over(earlier).alias(f"_o_{name}") for name in values]
    )
    within = (
        Window.partitionBy(key, "_chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = {
        name: F.coalesce(F.col(f"_o_{name}"), F.lit(0))
        + F.coalesce(F.sum(f"_v_{name}").over(within), F.lit(0))
        for name in values
    }
    joined = chunked.join(offsets, [key, "_chunk"])
    return joined.select(*rows.columns, *[v.alias(n) for n, v in sums.items()])
