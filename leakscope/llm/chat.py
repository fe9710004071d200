"""Chat formatting: every assistant turn becomes an example of its own.

The context of an example is all that comes before its reply, so the examples of
a conversation are prefixes of one formatted transcript. The transcript has a row
per turn, and every turn is exploded into the examples that hold it: an example is
its rows in order, of which only the reply is under the loss mask. No task holds a
whole conversation or example.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.arrow import small_slices
from leakscope.llm.common import once

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """A backslash more between every < and |, so no text holds a control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    """Also free of line ends, which close a role."""
    return escaped(F.replace(F.replace(role, F.lit("~"), F.lit("~t")), F.lit("\n"), F.lit("~n")))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("~n"), F.lit("\n")), F.lit("~t"), F.lit("~"))


def format_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, position, segment, start, reply_start, reply_chars, example, examples.

    The segments of a conversation by position are its transcript; ``start`` counts
    its characters before the segment. ``reply_start`` and ``reply_chars`` place the
    reply of an assistant turn in the transcript and are null for other turns.
    ``example`` is the first example that holds the turn, of ``examples`` in all,
    counted from 0; it equals their number after the last reply.

    Turns are ordered by turn (null first), role and text; repeated rows are turns
    of their own. Null roles and texts are empty, a null conv_id is a conversation.
    The order is found by a range sort, so a long conversation spreads over tasks
    and only the sums of its parts are added up in one.
    """
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), _escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    formed = rows.select(
        "*", F.length(head).alias("head_chars"), F.length(body).alias("body_chars"), F.concat(head, body, F.lit(CLOSE)).alias("segment")
    )
    order = ["conv_id", "turn", "role", "text"]
    ranged = once(
        formed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "turns"
    )
    chars = F.length("segment").cast("bigint")
    trained = F.col("role") == TRAINED
    totals = ranged.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), F.sum(chars).alias("chars"), F.count_if(trained).alias("replies")
    )
    conversation = Window.partitionBy("conv_id")
    before = conversation.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select(
        F.col("conv_id").alias("of_conv"),
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("replies").over(before), F.lit(0)).alias("replies_before"),
        F.sum("replies").over(conversation).alias("examples"),
    )
    placed = ranged.join(parts, F.expr("conv_id <=> of_conv AND part = of_part"))
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("chars_before") + F.sum(chars).over(upto) - chars
    replied = F.col("replies_before") + F.count_if(trained).over(upto) - trained.cast("bigint")
    return placed.select(
        "conv_id",
        (F.col("turns_before") + F.row_number().over(within) - 1).cast("bigint").alias("position"),
        "segment",
        start.cast("bigint").alias("start"),
        F.when(trained, (start + F.col("head_chars")).cast("bigint")).alias("reply_start"),
        F.when(trained, F.col("body_chars").cast("bigint")).alias("reply_chars"),
        replied.cast("bigint").alias("example"),
        "examples",
    )


def explode_examples(turns: DataFrame) -> DataFrame:
    """One row per example and turn in it: conv_id, example, is_last, position, segment, mask_start, mask_chars.

    The segments of an example by position are its text. The loss mask covers
    ``mask_chars`` characters of a segment from ``mask_start`` on, counted from 1: the
    example's own reply, which ends it. Both are null for its context, earlier replies
    too. ``is_last`` marks the longest example of a conversation. The turns after the
    last reply are in no example; they come once, with a null example.
    """
    of_turn = F.when(F.col("example") < F.col("examples"), F.sequence("example", F.col("examples") - 1))
    exploded = turns.select("*", F.explode_outer(of_turn).alias("of")).withColumnsRenamed({"example": "own", "of": "example"})
    masked = F.col("reply_start").isNotNull() & (F.col("example") == F.col("own"))
    return exploded.select(
        "conv_id",
        "example",
        F.coalesce(F.col("example") == F.col("examples") - 1, F.lit(False)).alias("is_last"),
        "position",
        "segment",
        F.when(masked, F.col("reply_start") - F.col("start") + 1).alias("mask_start"),
        F.when(masked, F.col("reply_chars")).alias("mask_chars"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, position, context_chars, reply_chars, example_chars.

    The example is the transcript's first ``example_chars`` characters. The context
    is what stands before the reply; only the reply is trainable.
    """
    return turns.where("reply_start IS NOT NULL").select(
        "conv_id",
        "position",
        F.col("reply_start").alias("context_chars"),
        "reply_chars",
        (F.col("start") + F.length("segment")).alias("example_chars"),
    )


def example_texts(turns: DataFrame) -> DataFrame:
    """The examples with their whole text, for conversations that fit into a row."""
    targets = examples(turns).withColumnRenamed("position", "target")
    earlier = turns.select(F.col("conv_id").alias("of_conv"), "position", "segment")
    met = targets.join(earlier, F.expr("conv_id <=> of_conv AND position <= target"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "segment"))), lambda s: s["segment"]), "")
    return met.groupBy("conv_id", F.col("target").alias("position"), "context_chars", "reply_chars").agg(whole.alias("text"))


def parse_examples(exploded: DataFrame) -> DataFrame:
    """conv_id, example, is_last, position, role, text and reply, read back from the examples.

    ``reply`` is the text under the loss mask, cut out by it, else null.
    """
    inner = F.substring("segment", F.lit(len(OPEN) + 1), F.length("segment") - len(OPEN) - len(CLOSE))
    line_end = F.locate("\n", inner)
    return exploded.select(
        "conv_id",
        "example",
        "is_last",
        "position",
        _unescaped_role(F.substring(inner, F.lit(1), line_end - 1)).alias("role"),
        unescaped(F.substring(inner, line_end + 1, F.length(inner))).alias("text"),
        unescaped(F.substring("segment", F.col("mask_start"), F.col("mask_chars"))).alias("reply"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The examples are written out and read back. ``turns_sha256`` runs over role, line
    end, text and line end of every turn of the longest example and of what follows
    it, ``loss_sha256`` over the text under the loss masks of all examples.
    ``formatted_chars`` adds up the examples and, once, what follows the last reply.
    The hashes need the turns in order; they are streamed, so memory holds one batch
    of them.
    """
    exploded = once(explode_examples(turns), "examples")
    sizes = exploded.groupBy(F.col("conv_id").alias("of_conv")).agg(F.sum(F.length("segment")).cast("bigint").alias("formatted_chars"))
    in_order = exploded.where("example IS NULL OR is_last OR mask_start IS NOT NULL")
    ordered = parse_examples(in_order).repartition("conv_id").sortWithinPartitions("conv_id", "position", "is_last")
    hashed = ordered.mapInArrow(_digested, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string")
    return hashed.join(sizes, F.expr("conv_id <=> of_conv")).drop("of_conv")


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars = conv_id, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        if row["is_last"] or row["example"] is None:
            self.turns += 1
            self.whole.update(f"{row['role']}\n{row['text']}\n".encode("utf-8", "surrogatepass"))
        if row["reply"] is not None:
            self.loss.update(row["reply"].encode("utf-8", "surrogatepass"))
            self.loss_chars += len(row["reply"])

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.turns,
            "turns_sha256": self.whole.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
        }


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())])
    now: _Digest | None = None
    for batch in small_slices(batches):
        done = []
        for row in batch.to_pylist():
            if now is None or now.conv_id != row["conv_id"]:
                done += [now.row()] if now else []
                now = _Digest(row["conv_id"])
            now.add(row)
        yield pa.RecordBatch.from_pylist(done, schema=kinds)
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], schema=kinds)
