import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakscope.llm import warc
from leakscope.session import shared_folder

BREAK = "\r\n\r\nWARC/1.1\r\n"
SCHEMA = "page_id bigint, url string, html string, serial int, digest string, segments string"


@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunks_are_reversible(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("size", [1, 3, 17, 4096])
def test_no_record_break_stays_in_a_block(size):
    payload = (BREAK * 3 + "x" + BREAK).encode()
    framed = warc.chunked(payload, size)
    assert warc._BREAK not in framed and warc.dechunked(framed) == payload


def test_ill_formed_chunks_are_refused():
    for body in (b"5\r\nab", b"zz\r\n", b"2\r\nabXX0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(body)


def rows():
    r = random.Random(4)
    long = "".join(r.choice("aé😀\r\n") for _ in range(50_000))
    pages = ["<p>one</p>", "<p>one</p>", None, "", f"a{BREAK}b", BREAK, long, long, "\r\n", "x\r\n\r\n"]
    return [(i, f"http://h/{i}\r\nX: y" if i == 3 else f"http://h/{i}", t) for i, t in enumerate(pages)] + [
        (None, None, "<p>one</p>"), (1, "http://h/1", "<p>one</p>"), (30, "u", long + "z"), (30, "u", long + "z"),
    ]


@pytest.mark.parametrize("segment_bytes", [7, 1000, 10**6])
def test_round_trip(spark, segment_bytes):
    given_rows = [r for r in rows() if segment_bytes > 100 or len(r[2] or "") < 1000]
    pages = spark.createDataFrame([(*r, 1, "own", "own") for r in given_rows], SCHEMA).repartition(3)
    path = shared_folder(spark, "test-warc")
    warc.write_archives(pages, path, segment_bytes=segment_bytes)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(given_rows) and not [r.fault for r in found if r.fault]
    largest = {}
    for i, _, t in given_rows:
        if i is not None:
            largest[t or ""] = max(i, largest.get(t or "", i))
    want = []
    for i, _, t in given_rows:
        data = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = largest.get(t or "")
        is_revisit = i is not None and i < top
        want.append((i, "revisit" if is_revisit else "response", digest, top if is_revisit else None, None if is_revisit else data))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = [(r.page_id, r.record_type, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_small_payloads_stay_responses(spark):
    path = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id bigint, url string, html string"), path, least_bytes=3)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_faults_are_named(spark, tmp_path):
    def record(**fields):
        body = fields.pop("body")
        return warc._header(**fields) + body + b"\r\n\r\n"

    bad = [
        record(WARC_Record_ID="<a>", WARC_Type="response", Content_Length=9, body=b"short"),
        record(WARC_Record_ID="<b>", WARC_Type="response", WARC_Segment_Number=1, Content_Length=2, body=b"xx"),
        record(WARC_Record_ID="<b2>", WARC_Type="continuation", WARC_Segment_Origin_ID="<b>", WARC_Segment_Number=3, Content_Length=1, body=b"y"),
        record(WARC_Record_ID="<c2>", WARC_Type="continuation", WARC_Segment_Origin_ID="<c>", WARC_Segment_Number=1, WARC_Segment_Total_Length=1, Content_Length=1, body=b"y"),
        record(WARC_Record_ID="<d>", WARC_Type="response", Content_Length=39, body=b"H 200\r\nTransfer-Encoding: chunked\r\n\r\nzz"),
        record(WARC_Record_ID="<e>", WARC_Type="response", WARC_Payload_Digest="sha1:AAAA", Content_Length=5, body=b"\r\n\r\nb"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(bad)))
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.fault for r in found) == ["chunks", "content length", "digest", "no origin", "segments missing"]
    assert all(r.payload is None for r in found)


def test_empty_table(spark):
    path = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_digest_expression(spark):
    text = spark.range(1).select(warc.sha1_base32(F.lit("abc").cast("binary")).alias("d")).first().d
    assert text == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
