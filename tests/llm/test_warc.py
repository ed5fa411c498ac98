import base64
import gzip
import hashlib

import pytest

from foliate.llm import warc as A

LEGACY_1 = (
    b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain 76\n"
    b"1 0 AlexaInternet\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
    b"http://a.example/x y 127.0.0.1 19961104142103 text/html 46\n"
    b"HTTP/1.0 200 OK\r\nContent-Type: a\r\n\r\nhello\nworld\n\n"
    b"junk line\n"
    b"dns:a.example 127.0.0.1 19961104 text/dns 5\n12345\n"
    b"http://a.example/cut 127.0.0.1 19961104142103 text/html 900\nHTTP/1.0 200 OK\r\n\r\nshort"
)


def test_legacy_version_1():
    got = list(A.parse_arc("old.arc", LEGACY_1))
    assert [(r[2], r[3], r[4], r[5], r[-1]) for r in got] == [
        ("http://a.example/x y", "1996-11-04T14:21:03Z", "response", False, b"hello\nworld"[: len(got[0][-1])]),
        ("dns:a.example", "1996-11-04T00:00:00Z", "resource", False, b"12345"),
        ("http://a.example/cut", "1996-11-04T14:21:03Z", "response", True, b"short"),
    ]
    assert len({r[6] for r in got}) == 3
    assert list(A.parse_arc("old.arc", gzip.compress(LEGACY_1))) == got


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip_of_records(version):
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\n\n\xff\x00 WARC/1.1\r\n\r\n\n"
    data = A.arc_header(version, "n.arc") + A.arc_record(version, "n.arc", 5, "http://u/", "20010203040506", block) * 2
    got = list(A.parse_arc("n.arc", data))
    assert [r[-2] + r[-1] for r in got] == [block, block] and got[0][7] == "9"
    assert got[0][9] == base64.b32encode(hashlib.sha1(got[0][-1]).digest()).decode()


def test_pages(spark):
    rows = [
        (5, "http://a/ b", "same"), (2, "http://b/", "same"), (9, None, "same"), (9, None, "same"), (1, "", None), (4, "u", ""),
        (7, "http://c/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc é\x00"), (None, "x", "same"), (8, "x", "long " * 200_000), (3, "\n", "one"),
    ]
    pages = spark.createDataFrame([(*r, 1, "clash") for r in rows], "page_id long, url string, html string, payload_bytes int, record_id string")

    def want(least):
        out = []
        for i, (page, _, html) in enumerate(rows):
            body = (html or "").encode()
            same = [(r[0] is None, r[0] or 0, j) for j, r in enumerate(rows) if (r[2] or "").encode() == body]
            first = min(same)[2]
            again = len(body) >= least and i != first
            out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", rows[first][0] if again else None))
        return sorted(out, key=str)

    for least in (0, 4):
        assert sorted((tuple(r) for r in A.round_trip(pages, least_bytes=least).collect()), key=str) == want(least)
    assert A.round_trip(pages.limit(0)).count() == 0


def test_rows_in_another_order_every_time(spark):
    def mixed(batches):
        for b in batches:
            yield b.sample(frac=1.0)

    rows = [(i, f"http://h/{i}", f"text {i % 50}") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).mapInPandas(mixed, "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in A.round_trip(pages).collect()}
    assert got == {i: ("response", None) if i < 50 else ("revisit", i % 50) for i in range(2000)}
