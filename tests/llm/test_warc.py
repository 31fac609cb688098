import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import common, warc

from .oracle import assert_same

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 64))
def test_chunked_round_trip(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("broken", [b"", b"zz\r\nab\r\n0\r\n\r\n", b"5\r\nab\r\n0\r\n\r\n", b"-1\r\n\r\n"])
def test_broken_framing(broken):
    with pytest.raises(ValueError):
        warc.unchunked(broken)


def test_reassembly_statuses():
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload", 3)
    cut = [(1, None, body[:20]), (2, None, body[20:40]), (3, len(body), body[40:])]
    digest = "sha1:" + hashlib.sha1(b"payload").hexdigest()
    assert warc.reassemble(cut[::-1] + cut[:1], digest)[2:] == (b"payload", "ok")
    assert warc.reassemble(cut[::2], digest)[3] == "missing_segment"
    assert warc.reassemble(cut[:2], digest)[3] == "missing_segment"
    assert warc.reassemble([*cut[:2], (3, 5, body[40:])], digest)[3] == "length_mismatch"
    assert warc.reassemble([*cut[:2], (3, len(body) - 7, body[40:-7])], digest)[3] == "bad_chunk"
    assert warc.reassemble(cut, "sha1:" + "0" * 40)[3] == "digest_mismatch"
    assert warc.reassemble([*cut, (2, None, b"other bytes")], None)[3] == "conflicting_segment"


@pytest.mark.parametrize("segment_bytes", [32_768, 200])
def test_write_and_read(spark, segment_bytes):
    big = "B\r\n\r\nWARC/1.1\r\n é" * 100
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", "small"), (3, None, None), (9, "http://c/", big), (4, "http://d/", "small"), (5, "u", big), (None, "n", big), (9, "http://c/", big), (6, "v", "")]
    rows += [(100 + k, "h", "hot " * 400) for k in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, answer string")
    path = common.fresh_path(spark, "warc-test")
    warc.write(df, path, segment_bytes=segment_bytes, records_per_file=7)
    got = warc.read(spark, path).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and h == html and len(data) >= 1000]
        last = max(same, default=None)
        revisit = page is not None and last is not None and page < last
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {r.status for r in got} == {"ok"}
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)


def test_pages_of_many_megabytes(spark):
    page = "line \u00e9\n" * 700_000
    df = spark.createDataFrame([(1, "http://a/", page), (2, "http://b/", page), (3, "http://c/", page[:-1])], "page_id long, url string, html string")
    path = common.fresh_path(spark, "warc-test")
    warc.write(df, path)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.status) for r in warc.read(spark, path, keep_payload=False).collect()}
    size = len(page.encode())
    assert got == {1: ("revisit", 2, size, "ok"), 2: ("response", None, size, "ok"), 3: ("response", None, size - 1, "ok")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_equals_its_sql(spark):
    assert_same(warc.op2_warc(spark, SF).toPandas(), "op2_warc", SF)


def test_empty_table(spark):
    path = common.fresh_path(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
