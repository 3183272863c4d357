from __future__ import annotations

import gzip
import hashlib

import pytest

from lupafiscal.llm import warc
from lupafiscal.session import new_run_folder
from tests.llm import cases

BIG = "<p>" + cases.prose(1, 20_000) + "</p>"
ROWS = [
    (5, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 100), (4, "http://b/ü ö\r\nX: y", "x" * 99), (2, "u", "x" * 99),
    (10, "u", None), (11, "u", ""), (12, "u", BIG), (1, "u", BIG), (13, "u", BIG + "!"), (14, "u", "é\r\n\r\nWARC/1.1\r\n" * 9), (None, "u", "x" * 100),
    (None, "u", "y" * 100), (None, "u", "y" * 100), (3, "http://a/2", "x" * 100), (13, "u", BIG + "!"), (15, "u", "0\r\n\r\n" * 5000),
]


def pages(spark, rows):
    filler = ("r", "d", "p")
    return spark.createDataFrame([(*r, *filler) for r in rows], "page_id long, url string, html string, record_id string, digest string, payload string")


def read(spark, rows, segment_bytes=3000):
    folder = new_run_folder(spark, "warc")
    warc.write(pages(spark, rows), folder, segment_bytes=segment_bytes)
    return warc.reassembled(warc.records(spark, folder))


def want(rows):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        f = first.get(html)
        revisit = f is not None and page != f
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment_bytes", [64, 3000, 1 << 20])
def test_round_trip(spark, segment_bytes):
    found = warc.resolved(warc.sized(read(spark, ROWS, segment_bytes))).collect()
    assert sorted(map(tuple, found), key=str) == want(ROWS)


def test_payloads_come_back(spark):
    found = read(spark, ROWS).filter("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in found} == {html or "" for _, _, html in ROWS}


def test_files_are_gzip_with_whole_records(spark, tmp_path):
    warc.write(pages(spark, ROWS), f"file://{tmp_path}/w", segment_bytes=500)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("w/part-*")))
    kinds = [r[1] for r in warc.parsed(data)]
    assert kinds.count("revisit") == 4 and kinds.count("continuation") > 100
    assert data.count(b"WARC-Segment-Origin-ID") == kinds.count("continuation")


def test_broken_records_raise():
    parts = [{"segment": 1, "block": b"ab", "total_length": None}, {"segment": 2, "block": b"cd", "total_length": 4}]
    assert warc.joined("r", parts[::-1]) == b"abcd"
    for broken in (parts[1:], parts[:1] + [{**parts[1], "segment": 3}], parts[:1] + [{**parts[1], "total_length": 5}]):
        with pytest.raises(ValueError):
            warc.joined("r", broken)
    for body in (b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(body)
    (record,) = warc.page_records("urn:page:1:x", "u", b"payload", "d", None, 1 << 20)
    with pytest.raises(ValueError):
        list(warc.parsed(record + b"no end"))


def test_empty_table(spark):
    assert warc.resolved(warc.sized(read(spark, []))).count() == 0
