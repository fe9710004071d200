"""Benchmark decontamination by templates: equal wording with other numbers, names and units.

Numbers, names and units become typed slots. Windows of the templates are joined
by hash; within a window every value of the item must then stand for one value of
the document. Windows whose tokens and values are all equal match whatever they
are made of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.arrow import list_bounds, mixed, small_slices
from leakscope.llm.common import once, sealed, text_or_empty

WINDOW = 13
# Shorter items are windows of their own length; under this one only word for word.
SHORTEST = 5
# Share of a window's tokens that must be plain words where values may differ.
LEAST_WORDS = 0.6
# The benchmark's window hashes as a bitmap: 4 MB however large the benchmark is. A
# million windows set 3 % of the bits; the join decides on what gets through.
BITMAP_BITS = 2**25

_TOKEN = r"[\p{L}\p{M}]+(?:['’]\p{L}+)?|\p{N}+(?:[.,]\p{N}+)*|[%$€£°]|[.!?\n]"
_ENDS = frozenset(".!?\n")
# Units of measure and of money.
UNITS = frozenset(
    "% $ € £ ° km m cm mm mi ft in kg g mg lb lbs oz l ml s sec secs min mins h hr hrs kmh mph"
    " percent dollar dollars euro euros pound pounds cent cents degree degrees"
    " second seconds minute minutes hour hours day days week weeks month months year years"
    " metre metres meter meters mile miles kilometre kilometres kilometer kilometers foot feet inch inches"
    " gram grams kilogram kilograms litre litres liter liters".split()
)
_NUMBER, _NAME, _UNIT = (np.uint64(k) for k in (1, 2, 3))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_TEMPLATE, _VERBATIM = _U(0), _U(0x5851F42D4C957F2D)


def _text_hash(token: str) -> int:
    total = 14695981039346656037
    for byte in token.encode("utf-8", "surrogatepass"):
        total = (total ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return total


class Templates:
    """Tokens of a batch of texts without sentence ends: codes, values, text bounds.

    ``codes`` has the slots by their type, ``plain_codes`` every token by its letters.
    """

    def __init__(self, column: pa.ListArray, known: dict[str, tuple[int, int]]):
        coded = column.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(known) > 300_000:
            known.clear()
        traits = [known.get(w) or known.setdefault(w, self._traits(w)) for w in words]
        kind = np.array([t[0] for t in traits], dtype=np.int8)
        code = np.array([t[1] for t in traits], dtype=np.uint64)
        every = coded.indices.to_numpy()
        bounds = list_bounds(column)
        is_end = kind[every] == 9 if len(every) else np.zeros(0, dtype=bool)
        opens = np.ones(len(every), dtype=bool)
        opens[1:] = is_end[:-1]
        opens[bounds[:-1][bounds[:-1] < len(every)]] = True
        keep = ~is_end
        self.bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        self.words, self.at = words, every[keep]
        kinds, opens = kind[self.at] if len(self.at) else np.zeros(0, np.int8), opens[keep]
        is_number = kinds == 1
        starts = np.zeros(len(self.at) + 1, dtype=bool)
        starts[self.bounds] = True
        beside = np.zeros(len(self.at), dtype=bool)
        beside[1:] |= is_number[:-1] & ~starts[1:-1]
        beside[:-1] |= is_number[1:] & ~starts[1:-1]
        self.plain_codes = code[self.at] if len(self.at) else np.zeros(0, np.uint64)
        is_name = (kinds == 2) & ~opens
        is_unit = (kinds == 3) & beside
        self.slot = is_number | is_name | is_unit
        self.opener = (kinds == 2) & opens
        self.codes = np.where(is_number, _NUMBER, np.where(is_name, _NAME, np.where(is_unit, _UNIT, self.plain_codes)))
        self.slots_before = np.concatenate([[0], np.cumsum(self.slot)])
        self.back = _powers(_BACK, len(self.at))
        power = _powers(_BASE, len(self.at))[:-1]
        self.sums = _sums(self.codes * power)
        self.plain_sums = _sums(self.plain_codes * power)

    @staticmethod
    def _traits(word: str) -> tuple[int, int]:
        """Kind (0 word, 1 number, 2 capitalised, 3 unit, 9 sentence end) and hash."""
        lower = word.lower()
        if word in _ENDS:
            return 9, 0
        kind = 1 if word[0].isnumeric() else 3 if lower in UNITS else 2 if word[0].isupper() and word[1:].islower() else 0
        return kind, _text_hash(lower)

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """Starts and hashes of the windows inside one text, by sort.

        ``verbatim`` has every window by its own tokens. ``template`` has those with
        slots and enough plain words, by the types of the slots. ``opened`` has
        templates whose first token opens a sentence with a capital, read as a name:
        after a colon or a quote the same token is one.
        """
        count = len(self.at) - size + 1
        if count < 1:
            return
        left = np.repeat(self.bounds[1:], np.diff(self.bounds))[:count] - np.arange(count)
        starts = np.nonzero(left >= size)[0]
        length = _U(size) * _U(0xD1342543DE82EF95)

        def hashes(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
            return (sums[at + size] - sums[at]) * self.back[at]

        yield starts, mixed(hashes(self.plain_sums, starts) + (length ^ _VERBATIM)), "verbatim"
        if size < SHORTEST:
            return
        n_slots = self.slots_before[starts + size] - self.slots_before[starts]
        fits = starts[(n_slots > 0) & (size - n_slots >= LEAST_WORDS * size)]
        yield fits, mixed(hashes(self.sums, fits) + (length ^ _TEMPLATE)), "template"
        opened = starts[self.opener[starts] & (size - n_slots - 1 >= LEAST_WORDS * size)]
        as_name = hashes(self.sums, opened) + _NAME - self.codes[opened]
        yield opened, mixed(as_name + (length ^ _TEMPLATE)), "opened"

    def values(self, start: int, size: int, sort: str) -> list[str]:
        """Type and value of each slot; none where the hash holds the values."""
        if sort == "verbatim":
            return []
        places = start + np.nonzero(self.slot[start : start + size])[0]
        slots = [f"{int(self.codes[p])}:{self.words[self.at[p]].lower()}" for p in places]
        return [f"{int(_NAME)}:{self.words[self.at[start]].lower()}", *slots] if sort == "opened" else slots


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 to base**count, modulo 2**64."""
    factors = np.full(count + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


_WINDOWS = "row_id bigint, text_key bigint, at int, size int, hash bigint, slots array<string>"


def _windowed(sizes: tuple[int, ...] | None, bitmap=None):
    """Windows of each text; of all sizes given, or just the fitting one of a benchmark item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        bits = bitmap.value if bitmap is not None else None
        for batch in small_slices(batches):
            texts = Templates(batch.column("tokens"), known)
            ids, keys = batch.column("row_id").to_pylist(), batch.column("text_key").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            lengths = np.diff(texts.bounds)
            for size in sizes or range(1, WINDOW + 1):
                for starts, hashes, sort in texts.windows(size):
                    if bits is not None:
                        wanted = _set_bits(bits, hashes)
                        starts, hashes = starts[wanted], hashes[wanted]
                    text = np.searchsorted(texts.bounds, starts, side="right") - 1
                    if bits is None:
                        wanted = np.minimum(lengths[text], WINDOW) == size
                        starts, hashes, text = starts[wanted], hashes[wanted], text[wanted]
                    for start, value, t in zip(starts.tolist(), hashes.view(np.int64).tolist(), text.tolist()):
                        row = (ids[t], keys[t], start - int(texts.bounds[t]), size, value, texts.values(start, size, sort))
                        for column, x in zip(out, row):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["row_id", "text_key", "at", "size", "hash", "slots"])

    return run


def _set_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = hashes % _U(BITMAP_BITS)
    return (bits[(places >> _U(6)).astype(np.int64)] >> (places & _U(63))) & _U(1) == 1


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit per window hash, gathered as at most BITMAP_BITS / 64 numbers."""
    place = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = windows.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {BITMAP_BITS - 1}) & 63 as int))")).alias("bits")
    )
    table = words.toArrow()
    bits = np.zeros(BITMAP_BITS // 64, dtype=np.uint64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return bits


def _tokenized(table: DataFrame, row_id: str, text: str) -> DataFrame:
    whole = text_or_empty(text)
    return table.select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.xxhash64(whole).alias("text_key"),
        F.regexp_extract_all(whole, F.lit(_TOKEN), F.lit(0)).alias("tokens"),
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it holds: doc_id, text_key, item_id, n_windows, changed.

    A document holds an item if a window of 13 tokens of both is equal word for word,
    or as a template in which every number, name and unit of the item stands for
    just one of the document, and no two names for the same one. Each window is
    judged by itself, so a value that fits nowhere costs only the windows that hold
    it. ``n_windows`` counts the windows found; ``changed`` says that some value in
    them differs, at every place of the document where the item was found.

    Items of 5 to 12 tokens must occur whole; shorter ones also word for word, and so
    must windows mostly made of slots. A capital that opens a sentence is a plain
    word, and a name too where it is a window's first token. ``text_key`` is the
    64-bit hash of the text, so that rows that share an id, or have none, stay
    apart; repeated rows count once. Texts of any length are read whole, one at a
    time. Null and empty texts hold nothing and empty tables give no rows.
    """
    spark = docs.sparkSession
    items = once(_tokenized(benchmark, item_id, item_text).mapInArrow(_windowed(None), _WINDOWS), "items")
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))  # at most 13 numbers
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    found = _tokenized(docs, doc_id, text).mapInArrow(_windowed(sizes or (WINDOW,), bitmap), _WINDOWS)
    known = items.select(
        F.col("row_id").alias("item_id"), F.col("at").alias("item_at"), "size", "hash", F.col("slots").alias("item_slots")
    ).distinct()
    met = found.join(known, ["hash", "size"]).where(F.size("slots") == F.size("item_slots"))
    pairs = F.array_distinct(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")))
    names = F.filter(pairs, lambda p: p["item"].startswith(f"{int(_NAME)}:"))
    stands_for_one = F.size(F.array_distinct(pairs["item"])) == F.size(pairs)
    names_apart = F.size(F.array_distinct(names["doc"])) == F.size(names)
    judged = met.select(
        F.col("row_id").alias("doc_id"),
        "text_key",
        "item_id",
        "at",
        (F.col("at") - F.col("item_at")).alias("shift"),
        (F.col("slots") != F.col("item_slots")).alias("differs"),
        (stands_for_one & names_apart).alias("is_consistent"),
    )
    return (
        judged.where("is_consistent")
        .groupBy("doc_id", "text_key", "item_id", "shift")
        .agg(F.count_distinct("at").alias("n_windows"), F.max("differs").alias("changed"))
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.sum("n_windows").alias("n_windows"), F.min("changed").alias("changed"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    held = leaks(docs, benchmark, doc_id, text, **names).select(F.col("doc_id").alias("leak"), F.col("text_key").alias("leak_key"))
    rows = sealed(docs, doc=F.col(doc_id).cast("bigint"), key=F.xxhash64(text_or_empty(text)))
    return rows.join(held.distinct(), F.expr("doc <=> leak AND key = leak_key"), "left_anti").select("row.*")
