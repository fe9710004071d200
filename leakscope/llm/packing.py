"""Packing by powers of two: no sequence crosses documents and none needs padding."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.arrow import small_slices
from leakscope.llm.common import text_or_empty

MAX_LENGTH = 2048
END_ID = 1
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class Coder:
    """Token ids of texts by a byte-level BPE of the tokenizers library.

    With a file of the same vocabulary as ranks the merges run in tiktoken, which
    cuts words by the same pattern, gives the same ids and takes a quarter of the
    time. It knows no added tokens, so texts that hold one go the first way.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


@functools.lru_cache(maxsize=2)
def coder(*files: str | None) -> Coder:
    return Coder(*files)


def piece_lengths(total: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Whole pieces of the longest length, then the binary digits of the rest, large ones first."""
    rest = total % max_length
    return [max_length] * (total // max_length) + [1 << k for k in range(max_length.bit_length(), -1, -1) if rest >> k & 1]


def _pieces(files: tuple, end_id: int, max_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(*files).encode
        end = np.array([end_id], dtype="<u4")
        for batch in small_slices(batches):
            docs, starts, lengths, totals, ids = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens, at = np.concatenate([encode(text), end]), 0
                for length in piece_lengths(len(tokens), max_length):
                    docs.append(doc)
                    starts.append(at)
                    lengths.append(length)
                    totals.append(len(tokens))
                    ids.append(tokens[at : at + length].tobytes())
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs, starts, lengths, totals, ids), _SCHEMA)], schema=_SCHEMA)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    max_length: int = MAX_LENGTH,
    ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit numbers. A document, its ids and the
    end id, is cut into pieces of ``max_length``, a power of two, and one piece for
    each binary digit of the rest. Every piece is a sequence of its own, so no
    sequence crosses documents, all have a power of two as length and none is
    padded. A batch takes sequences of one length: :func:`write_buckets` keeps
    them apart.

    ``tokenizer`` is a file of the tokenizers library; ``ranks`` and ``pattern`` may
    give the same vocabulary to the faster encoder, see :class:`Coder`. All machines
    must find the files. A null or empty text is its end id alone. Rows without an id and repeated rows
    are packed like others, each on its own. An empty table gives no rows.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
    pieces = texts.mapInArrow(_pieces((tokenizer, ranks, pattern), end_id, max_length), schema)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The packed sequences in one folder per length, so that a batch has equal lengths."""
    pieces.write.partitionBy("length").mode("overwrite").parquet(path)
