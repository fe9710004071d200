"""WARC archives with segmented records and chunked payloads.

Writing cuts long records into segments; reading groups the continuations by the
record they belong to, orders and checks them, and decodes the chunked payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm.arrow import small_slices
from leakscope.llm.common import once

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
_START = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
# What divides two records of a file. Writing keeps it out of the blocks.
_BREAK = _END + _START
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits."""
    digits = F.sha1(payload)
    letters = []
    for group in range(4):
        bits = F.conv(F.substring(digits, 10 * group + 1, 10), 16, 10).cast("bigint")
        for k in range(8):
            five = F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(_BASE32), five + 1, F.lit(1)))
    return F.concat(*letters)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; a record break in the payload is divided by a chunk's end."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        found = payload.find(_BREAK, at, end + len(_BREAK) - 1)
        if found >= 0:
            end = min(end, found + len(_END) + 2)
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; an ill-formed one raises ValueError."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[at : at + size])
        at += size + 2


def _header(**fields) -> bytes:
    lines = [f"{name.replace('_', '-')}: {value}\r\n" for name, value in fields.items() if value is not None]
    return _START + "".join(lines).encode() + b"\r\n"


def _records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            records = []
            for row in batch.to_pylist():
                name = f"<urn:page:{row['page_id']}:{row['serial']}>"
                shared = {"WARC_Page_ID": row["page_id"], "WARC_Target_URI": row["url"], "WARC_Payload_Digest": f"sha1:{row['digest']}"}
                if row["refers_to"] is not None:
                    block = _HTTP
                    shared |= {"WARC_Type": "revisit", "WARC_Profile": _PROFILE, "WARC_Refers_To": f"<urn:page:{row['refers_to']}>"}
                else:
                    block = _HTTP + chunked(row["payload"])
                    shared |= {"WARC_Type": "response"}
                parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                for number, part in enumerate(parts, 1):
                    fields = {"WARC_Record_ID": name} | shared if number == 1 else {
                        "WARC_Record_ID": f"<urn:page:{row['page_id']}:{row['serial']}:{number}>",
                        "WARC_Type": "continuation",
                        "WARC_Segment_Origin_ID": name,
                    }
                    fields |= {"Content_Type": "application/http;msgtype=response", "Content_Length": len(part)}
                    if len(parts) > 1:
                        fields["WARC_Segment_Number"] = number
                    if len(parts) > 1 and number == len(parts):
                        fields["WARC_Segment_Total_Length"] = len(block)
                    records.append(_header(**fields) + part)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    return run


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write one record per page, the html in UTF-8 as payload, to gzip files in ``path``.

    Of pages with equal payloads of at least ``least_bytes`` the one with the largest
    id becomes a response, the others revisits of it. Pages without an id cannot be
    referred to and are responses. A null html is an empty payload, line ends in a
    url become blanks. Repeated rows are records of their own.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]+", " ").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", sha1_base32(F.col("payload")))
    # Digests are combined per task first; only those of several pages are kept.
    shared = once(
        rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.min("page_id").alias("smallest"))
        .where("largest > smallest")
        .select("digest", "largest"),
        "shared-payloads",
    )
    placed = rows.join(shared, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("largest") > F.col("page_id"), F.col("largest")).alias("refers_to"),
        F.monotonically_increasing_id().alias("serial"),
    )
    records = placed.mapInArrow(_records(segment_bytes), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", _END.decode()).option("compression", "gzip").mode("overwrite").text(path)


_RECORD = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload binary, fault string"
_PARSED = f"{_RECORD}, origin string, segment int, total bigint, body binary"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [pa.field(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(", "))]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches):
        yield _batch([_parse(raw) for raw in batch.column("raw").to_pylist()], _PARSED)


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _parse(raw: bytes) -> tuple:
    head, _, body = raw.removeprefix(_START).partition(_END)
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = _number(fields.get("content-length"))
    fault = None
    if length is None or len(body) - length not in (0, len(_END)):
        fault = "content length"
    else:
        body = body[:length]
    record, kind = fields.get("warc-record-id"), fields.get("warc-type")
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    refers = _number((fields.get("warc-refers-to") or "").removeprefix("<urn:page:").removesuffix(">"))
    named = (_number(fields.get("warc-page-id")), fields.get("warc-target-uri"), kind, digest, refers)
    segment = _number(fields.get("warc-segment-number"))
    if segment is None and kind != "continuation":
        payload, fault = _payload(kind, digest, body, fault)
        return (*named, payload, fault, None, None, None, None)
    origin = fields.get("warc-segment-origin-id") if kind == "continuation" else record
    return (*named, None, fault, origin, segment or 0, _number(fields.get("warc-segment-total-length")), body)


def _payload(kind: str | None, digest: str | None, block: bytes, fault: str | None) -> tuple[bytes | None, str | None]:
    """The payload of a whole block, without HTTP head and framing, and what is wrong with it."""
    if fault is None and kind not in ("response", "revisit"):
        fault = "no origin"
    if fault is not None or kind == "revisit":
        return None, fault
    head, _, body = block.partition(_END)
    try:
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None, "chunks"
    if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return None, "digest"
    return payload, None


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of records whose segments were grouped."""
    for batch in small_slices(batches):
        rows = []
        for row in batch.to_pylist():
            segments, fault = sorted(row["segments"], key=lambda s: s["segment"]), row["fault"]
            block = b"".join(s["body"] for s in segments)
            total = next((s["total"] for s in segments if s["total"] is not None), None)
            if fault is None and [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                fault = "segments missing"
            if fault is None and total != len(block):
                fault = "total length"
            payload, fault = _payload(row["record_type"], row["payload_digest"], block, fault)
            rows.append((*(row[c] for c in ("page_id", "url", "record_type", "payload_digest", "refers_to")), payload, fault))
        yield _batch(rows, _RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_digest, refers_to, payload, fault.

    Files are read as streams divided at record breaks. The segments of a record
    are grouped by its id, so a group is as large as one record; records of one
    segment are not shuffled. ``fault`` names what is wrong with a record, null if
    nothing: content length, segments missing, total length, chunks, digest, no
    origin. Faulty records have no payload but are not dropped. Revisits carry no
    payload of their own. Archives without records give no rows.
    """
    raw = spark.read.option("lineSep", _BREAK.decode()).text(path).select(F.col("value").cast("binary").alias("raw"))
    records = raw.mapInArrow(_parsed, _PARSED)
    whole = records.where("segment IS NULL").select("page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "fault")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("page_id", "url", "payload_digest", "refers_to")]
    kind = F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type")
    cut = (
        records.where("segment IS NOT NULL")
        .groupBy("origin")
        .agg(*first, kind, F.collect_list(F.struct("segment", "total", "body")).alias("segments"), F.max("fault").alias("fault"))
    )
    return whole.union(cut.mapInArrow(_joined, _RECORD))
