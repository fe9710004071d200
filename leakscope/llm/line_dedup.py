"""Line deduplication: exact copies and lines within one edit of an earlier line.

The deletion neighbourhood of a line holds the line with any one character left
out, with the place of the gap, and the line itself with an empty gap at any
place. Two lines are within one edit just if they share such a variant, and all
lines that share one are within one edit of each other, so the earliest of a
variant stands for all and no pairs are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import SPACES, once, probably_in, sealed, text_or_empty

# Exact copies count from one character on.
MIN_CHARS = 1
# In shorter lines one edit makes another line, not a near copy (parameter near_chars).
NEAR_CHARS = 8
_PLACES = 2**32
_MASK = 2**40 - 1


def _lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Lines of the documents with an id: their order in the corpus and 128 hash bits."""
    split = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.split(text_or_empty(text), "\n").alias("lines"))
    lines = split.where("doc IS NOT NULL").select("doc", F.posexplode_outer("lines").alias("position", "line"))
    order = F.col("doc").cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(10,0)") + F.col("position")
    is_blank = F.length(F.btrim("line", F.lit(SPACES))) == 0
    return lines.where((F.length("line") >= min_chars) & ~is_blank).select(
        "doc",
        "position",
        "line",
        order.cast("decimal(38,0)").alias("order"),
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
    )


def _half_keys() -> dict[str, Column]:
    """Keys of which two lines within one edit share one.

    With the longer line cut in the middle, one edit leaves one half as it is.
    """
    keys = {}
    for more in (0, 1):
        longer = F.length("line") + more
        head = F.floor(longer / 2).cast("int")
        keys[f"head{more}"] = F.xxhash64(F.lit("head"), longer, F.left("line", head))
        keys[f"tail{more}"] = F.xxhash64(F.lit("tail"), longer, F.right("line", longer - head))
    return keys


_HALVES = ("head0", "tail0", "head1", "tail1")


def _suspects(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """number, order, h1 and line of first lines that share a half with another.

    Numbers rise with the order; lines of one order have numbers of their own.
    """
    halves = firsts.where("head0 IS NOT NULL").select("h1", "order", F.explode(F.array(*_HALVES)).alias("half"))
    shared = once(halves.groupBy("half").count().where("count > 1").select("half"), "halves")
    found = halves.where(probably_in(shared, "half")(F.col("half"))).join(shared, "half")
    suspects = once(found.select("h1", "order", F.xxhash64("h1", "order").alias("key")).distinct(), "suspects")
    candidates = lines.select("h1", "order", "line").where(probably_in(suspects, "key")(F.xxhash64("h1", "order")))
    texts = candidates.join(suspects.select("h1", "order"), ["h1", "order"]).dropDuplicates(["h1", "order"])
    return once(texts.orderBy("order", "h1").withColumn("number", F.monotonically_increasing_id()), "suspect-lines")


def _near_firsts(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1 and order of lines with an earlier line one edit away, and that line's order."""
    texts = _suspects(lines, firsts)
    # Dealt as whole lines: their characters, twenty times as many bytes, then stay where they are.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = texts.repartition(tasks, "number").select(
        "number", F.length("line").alias("chars"), F.posexplode(F.split("line", "")).alias("at", "char")
    ).where("at < chars")
    line = Window.partitionBy("number")
    before = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def masked(*parts) -> Column:
        return F.xxhash64(*parts).bitwiseAND(F.lit(_MASK))

    from_start, from_end = masked("char", "at"), masked("char", F.col("chars") - F.col("at"))
    summed = chars.select("number", "chars", "at", from_start.alias("own"), from_end.alias("own_end")).select(
        "*",
        F.sum("own").over(before).alias("head"),
        (F.sum("own_end").over(line) - F.sum("own_end").over(before)).alias("tail"),
    )

    def variant(length, at, head, tail) -> Column:
        return F.struct(length.alias("length"), at.alias("at"), head.alias("head"), tail.alias("tail"))

    at, chars_, nothing = F.col("at"), F.col("chars"), F.lit(0).cast("bigint")
    variants = F.array(
        variant(chars_ - 1, at, F.col("head") - F.col("own"), F.col("tail")),
        variant(chars_, at, F.col("head") - F.col("own"), F.col("tail") + F.col("own_end")),
        F.when(at == chars_ - 1, variant(chars_, chars_, F.col("head"), nothing)),
    )
    keyed = summed.select("number", F.explode(F.array_compact(variants)).alias("v")).select(
        "number", F.xxhash64("v.length", "v.head").alias("left"), F.xxhash64("v.at", "v.tail").alias("right")
    )
    earliest = keyed.withColumn("first", F.min("number").over(Window.partitionBy("left", "right")))
    near = earliest.where(F.col("first") < F.col("number")).groupBy("number").agg(F.min("first").alias("first"))
    origin = texts.select(F.col("number").alias("first"), F.col("order").alias("first_order"), F.col("line").alias("first_line"))
    pairs = near.join(texts, "number").join(origin, "first")
    earlier = (F.col("first_order") < F.col("order")) & (F.levenshtein("line", "first_line", 1) == 1)
    return pairs.where(earlier).select("h1", F.col("order").alias("exact"), F.col("first_order").alias("first")).distinct()


def line_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    max_edits: int = 1,
    near_chars: int = NEAR_CHARS,
) -> DataFrame:
    """Lines that copy an earlier one: doc, position, chars, h1, kind, first_doc, first_position.

    Earlier means a smaller doc_id, or a smaller position in the same document.
    ``kind`` is ``exact`` for an equal line and ``near`` for one within one edit
    (a character put in, left out or exchanged); the first line named is the
    earliest of either sort, whether or not it is a copy itself. ``max_edits`` 0
    leaves near copies out; larger bounds are refused, as a neighbourhood grows
    with the power of the bound.

    Blank lines and lines under ``min_chars`` code points are never copies, and lines
    under ``near_chars`` neither are nor make near ones. Rows without an id
    have no place in the order: their lines neither are nor make copies. Rows
    that share an id count as one document whose lines at the same position are
    not earlier than one another. Null texts are empty; an empty table gives no
    rows. Hashes have 128 bits for exact copies; near ones are verified.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = _lines(docs, doc_id, text, min_chars)
    firsts = once(
        lines.select("h1", "h2", "order", *[F.when(F.length("line") >= near_chars, key).alias(name) for name, key in _half_keys().items()])
        .groupBy("h1", "h2")
        .agg(F.min("order").alias("order"), F.count("*").alias("n"), *[F.max(name).alias(name) for name in _HALVES]),
        "first-lines",
    )
    known = firsts.select("h1", "h2", F.col("order").alias("exact"), "n")
    if max_edits:
        known = known.join(_near_firsts(lines, firsts), ["h1", "exact"], "left")
    else:
        known = known.withColumn("first", F.lit(None).cast("decimal(38,0)"))
    known = once(known.where("n > 1 OR first IS NOT NULL"), "known-lines")
    is_exact = F.col("order") > F.col("exact")
    first = F.least(F.when(is_exact, F.col("exact")), F.col("first"))
    found = (
        lines.select("doc", "position", F.length("line").alias("chars"), "h1", "h2", "order")
        .join(known, ["h1", "h2"])
        .where(is_exact | (F.col("first") < F.col("order")))
        .withColumn("origin", first)
    )
    place = F.pmod("origin", F.lit(_PLACES).cast("decimal(38,0)"))
    return found.select(
        "doc",
        "position",
        "chars",
        "h1",
        F.when(is_exact, "exact").otherwise("near").alias("kind"),
        ((F.col("origin") - place) / F.lit(_PLACES)).cast("bigint").alias("first_doc"),
        place.cast("int").alias("first_position"),
    )


def deduplicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    max_edits: int = 1,
    most_copied: float = 1.0,
    near_chars: int = NEAR_CHARS,
) -> DataFrame:
    """``row`` of each document, its ``kept_text`` and what was cut from it.

    ``n_lines``, ``n_exact`` and ``n_near`` count all lines and the copies among
    them. Copied lines leave the text, but where lines of other documents make up
    more than ``most_copied`` of its characters, those stay: such a text is a copy
    or a revision as a whole, and its remains would hide that. Order and form of
    the other lines stay as they are. See :func:`line_copies` for what a copy is.
    """
    copies = line_copies(docs, doc_id, text, min_chars, max_edits, near_chars)
    foreign = F.col("first_doc") != F.col("doc")
    mark = F.concat_ws(":", "position", "h1")
    by_doc = copies.groupBy("doc").agg(
        F.collect_list(F.when(~foreign, mark)).alias("own"),
        F.collect_list(F.when(foreign, mark)).alias("foreign"),
        F.sum(F.when(foreign, F.col("chars"))).alias("foreign_chars"),
        F.count(F.when(F.col("kind") == "exact", 1)).alias("n_exact"),
        F.count(F.when(F.col("kind") == "near", 1)).alias("n_near"),
    )
    rows = sealed(docs, doc=F.col(doc_id).cast("bigint")).join(by_doc, "doc", "left")
    joined = rows.withColumn("text", text_or_empty(F.col("row")[text])).withColumn("lines", F.split("text", "\n"))
    mostly_copied = F.coalesce(F.col("foreign_chars") > F.lit(most_copied) * F.length("text"), F.lit(False))
    cut = F.when(mostly_copied, F.col("own")).otherwise(F.concat("own", "foreign"))
    marked = joined.withColumn("cut", F.coalesce(cut, F.array().cast("array<string>"))).withColumn(
        "marks", F.transform("lines", lambda line, i: F.concat_ws(":", i, F.xxhash64(line)))
    )
    left = F.transform(
        F.array_except("marks", "cut"), lambda m: F.get(F.col("lines"), F.split_part(m, F.lit(":"), F.lit(1)).cast("int"))
    )
    return marked.select(
        "row",
        F.when(F.size("cut") == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce("n_exact", F.lit(0)).cast("bigint").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )
