"""Token ids in binary files of fixed bit width.

A file is one shard: a header, a directory of its documents, the offset of each
block and the blocks. An id takes the fewest bits that hold every id of the
vocabulary, and a block is a whole number of 64-bit words, so numpy unpacks blocks
column by column and a reader may start at any of them.
"""

from __future__ import annotations

import functools
import os
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope.llm.arrow import list_bounds, small_slices
from leakscope.llm.common import text_or_empty

END_ID = 2
#: Ids of a block, a multiple of 64.
BLOCK_IDS = 4096
#: A shard is closed at the document that brings it to so many ids.
SHARD_IDS = 4_000_000
#: Words whose ids a worker remembers, and as many that it last set aside.
KNOWN_WORDS = 500_000

_MAGIC = b"IDBITS01"
_HEADER = struct.Struct("<8sIIIIQQ")


def width(vocabulary: int, end_id: int = END_ID) -> int:
    """Bits that hold every id below the vocabulary's size, and the end id."""
    return max(1, max(vocabulary - 1, end_id).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """The ids one after another, ``bits`` each, low bits first, in whole 64-bit words."""
    rows = -(-len(ids) // 64)
    padded = np.zeros(rows * 64, dtype=np.uint64)
    padded[: len(ids)] = ids
    columns, words = padded.reshape(rows, 64), np.zeros((rows, bits), dtype="<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= columns[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= columns[:, k] >> np.uint64(64 - shift)
    return words[:, :bits].tobytes()


def unpack_ids(packed: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed words."""
    rows = -(-count // 64)
    words = np.frombuffer(packed, dtype="<u8", count=rows * bits).reshape(rows, bits)
    ids, mask = np.empty((rows, 64), dtype="<u4"), np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        ids[:, k] = value & mask
    return ids.reshape(-1)[:count]


def shard_bytes(doc_ids: list, ids: list[np.ndarray], bits: int, part: int, first: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A shard of whole documents; ``first`` counts the ids of the part before it."""
    lengths = np.array([len(x) for x in ids], dtype="<u8")
    total = int(lengths.sum())
    payload = pack_ids(np.concatenate(ids) if ids else np.zeros(0, "<u4"), bits)
    blocks = -(-total // block_ids)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * np.uint64(block_ids * bits // 8), np.uint64(len(payload)))
    named = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    header = _HEADER.pack(_MAGIC, bits, block_ids, part, len(ids), first, total)
    return b"".join([header, named.tobytes(), numbers.tobytes(), lengths.tobytes(), offsets.tobytes(), payload])


class Shard:
    """One file's bytes, or a memory map of them; ids are unpacked when asked for."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        magic, self.bits, self.block_ids, self.part, self.n_docs, self.first, self.n_ids = _HEADER.unpack_from(self.data)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEADER.size
        named = np.frombuffer(self.data, np.uint8, self.n_docs, at)
        at += self.n_docs
        numbers = np.frombuffer(self.data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.doc_ids = [int(n) if known else None for n, known in zip(numbers.tolist(), named.tolist())]
        self.lengths = np.frombuffer(self.data, "<u8", self.n_docs, at).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        at += 8 * self.n_docs
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids from place ``start`` of the shard on; only the blocks they lie in are unpacked."""
        if start < 0 or count < 0 or start + count > self.n_ids:
            raise IndexError("outside the shard")
        if count == 0:
            return np.zeros(0, dtype="<u4")
        low, high = start // self.block_ids, (start + count - 1) // self.block_ids + 1
        begin, end = self.payload + self.offsets[low], self.payload + self.offsets[high]
        held = min(high * self.block_ids, self.n_ids) - low * self.block_ids
        skip = start - low * self.block_ids
        return unpack_ids(self.data[begin:end], self.bits, held)[skip : skip + count]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.lengths[k]))


class WordCoder:
    """Ids of texts by a tokenizer that cuts at white space and drops it.

    Such a tokenizer gives a text the ids of its white-space words one after another,
    so each different word is encoded once, by the library, and remembered. To have
    fewer different words, ASCII capitals are lowered if the tokenizer does so anyway,
    and marks that it cuts from the letter before are cut off first. Texts with an
    added token, in any case, go without that. A word of small ASCII letters goes to
    the tokenizer's model at once, if the steps before the model leave such words whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [x.content.lower() for x in self.whole.get_added_tokens_decoder().values()]
        normal = self.whole.normalizer
        capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.lowers = normal is not None and normal.normalize_str(capitals) == capitals.lower()
        marks = "".join(m for m in ".,;:!?" if self._cuts(m))
        self.marks = f"([A-Za-z])([{marks}])" if marks else None
        self.model = self.whole.model
        self.leaves_letters = self._leaves(capitals.lower() * 4) and not any(x.isalpha() for x in self.added)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cuts(self, mark: str) -> bool:
        pre = self.whole.pre_tokenizer
        return pre is not None and all([x for x, _ in pre.pre_tokenize_str("b" + rest)][0] == "b" for rest in (mark, f"{mark}c", f"{mark}{mark}'s"))

    def _leaves(self, letters: str) -> bool:
        """Whether the steps before the model give the letters back as one piece."""
        normal, pre = self.whole.normalizer, self.whole.pre_tokenizer
        if normal is not None and normal.normalize_str(letters) != letters:
            return False
        return pre is not None and [x for x, _ in pre.pre_tokenize_str(letters)] == [letters]

    def vocabulary(self) -> int:
        return self.whole.get_vocab_size(with_added_tokens=True)

    def _simpler(self, texts: pa.StringArray) -> pa.StringArray:
        lowered = pc.ascii_lower(texts)
        if any(pc.any(pc.match_substring(lowered, x)).as_py() for x in self.added):
            return texts
        texts = lowered if self.lowers else texts
        return pc.replace_substring_regex(texts, self.marks, r"\1 \2") if self.marks else texts

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words; those in use stay remembered."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        others = []
        for k in missing:
            word = words[k]
            ids = self.older.get(word)
            if ids is None and self.leaves_letters and word.isascii() and word.isalpha() and word.islower():
                ids = array("I", [x.id for x in self.model.tokenize(word)]).tobytes()
            if ids is None:
                others.append(k)
            else:
                self.known[word] = found[k] = ids
        for k, coded in zip(others, self.whole.encode_batch_fast([words[k] for k in others], add_special_tokens=False)):
            self.known[words[k]] = found[k] = array("I", coded.ids).tobytes()
        return found

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text begins in them (one bound more than texts)."""
        lists = pc.ascii_split_whitespace(self._simpler(texts))
        coded = lists.flatten().dictionary_encode()
        found = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begins = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        order = coded.indices.to_numpy()
        counts = sizes[order]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(begins[order] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[list_bounds(lists)]


@functools.lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def _encoded(batch: pa.RecordBatch, coder: WordCoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the batch's documents, each with its end id, and the bounds between them."""
    ids, bounds = coder.encode(batch.column("text"))
    of_doc = np.repeat(np.arange(len(batch)), np.diff(bounds))
    every = np.empty(len(ids) + len(batch), dtype="<u4")
    every[np.arange(len(ids)) + of_doc] = ids
    every[bounds[1:] + np.arange(len(batch))] = end_id
    return every, bounds + np.arange(len(batch) + 1)


def _shards(path: str, end_id: int, bits: int, block_ids: int, shard_ids: int):
    """Files of this task's documents, in the order they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        part, first, held, doc_ids, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def closed() -> pa.RecordBatch:
            data = shard_bytes(doc_ids, ids, bits, part, first, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["shard"])

        for batch in small_slices(batches):
            every, bounds = _encoded(batch, coder, end_id)
            for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                doc_ids.append(doc_id)
                ids.append(every[low:high])
                held += high - low
                if held >= shard_ids:
                    yield closed()
                    first, held, doc_ids, ids = first + held, 0, [], []
        if doc_ids:
            yield closed()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    vocabulary: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Write the ids of all documents, each followed by the end id, in ascending doc_id order.

    The files of ``path`` sorted by name are in that order; see the module's text for
    their form. ``tokenizer`` is a file of the tokenizers library that cuts at white
    space and drops it; all machines must find it. ``vocabulary``, its size, gives the
    bit width and is read from the file where it is left out.

    A null or empty text is its end id alone. Rows that share an id are documents of
    their own, in the order of their texts' hashes; rows without an id come first. A document lies in
    one shard, so a very long text makes a large one. An empty table gives no shard.
    """
    if block_ids < 64 or block_ids % 64:
        raise ValueError("block_ids must be a multiple of 64")
    bits = width(vocabulary or word_coder(tokenizer).vocabulary(), end_id)
    digest = F.xxhash64("text")  # parts rows of one id without carrying texts into the sampled bounds
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    ranged = texts.repartitionByRange("doc_id", digest).sortWithinPartitions("doc_id", digest, "text")
    shards = ranged.mapInArrow(_shards(tokenizer, end_id, bits, block_ids, shard_ids), "shard binary")
    lines = shards.select(F.col("shard").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            if not data.is_valid or len(data.as_buffer()) < _HEADER.size:
                continue
            shard = Shard(data.as_buffer())
            at = 0
            while at < shard.n_docs:  # a few megabytes of ids at a time
                to = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + 1_000_000)))
                counts = shard.lengths[at:to]
                ids = shard.ids(int(shard.starts[at]), int(counts.sum()))
                offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
                found = pa.Array.from_buffers(
                    pa.large_binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.part] * (to - at), pa.int32()),
                        pa.array(shard.first + shard.starts[at:to], pa.int64()),
                        pa.array(shard.doc_ids[at:to], pa.int64()),
                        pa.array(counts, pa.int64()),
                        found,
                    ],
                    ["part", "place", "doc_id", "n_tokens", "ids"],
                )
                at = to


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """part, place, doc_id, n_tokens, ids of each document of the files.

    ``ids`` are little-endian unsigned 32-bit numbers. ``place`` counts the ids before
    the document in its part; :func:`with_starts` adds up the parts.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "part int, place bigint, doc_id bigint, n_tokens bigint, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """The rows with ``start``, the ids of all documents before, in place of part and place.

    There is a row per part, one for each task that wrote, so their sums are broadcast.
    ``rows`` is read twice: hand over stored ones.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(bases), "part")
    return joined.withColumn("start", F.col("base") + F.col("place")).drop("part", "place", "base")
