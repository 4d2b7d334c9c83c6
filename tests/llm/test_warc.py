"""WARC records written, indexed and read back."""

import base64
import hashlib

import pytest

from tendero.llm.warc import look_up, read_archive, write_archive, write_index

PAGES = [
    (5, "https://www.example.com/a?x=1#f", "<p>ä</p>"), (2, "http://example.com/b", "<p>ä</p>"), (7, "http://EXAMPLE.net", "<p>ä</p>"),
    (3, None, None), (4, "no address", ""), (6, "ftp://example.org/\nline", "x"), (None, "http://a.b/", "x"), (8, "http://example.com/b", "x" * 300_000),
    (9, "http://example.com/b", "y\r\n\r\nz"), (2, "http://example.com/b", "<p>ä</p>"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "extra", 1) for r in PAGES], "page_id long, url string, html string, key string, digest int").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_every_page_comes_back(pages, least):
    found = read_archive(write_index(write_archive(pages, least))).collect()
    first = {}
    for i, _, html in PAGES:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(i, first.get(body, i))
    wanted = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        to = first.get(body)
        to = to if i is not None and to is not None and to < i else None
        wanted.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(wanted, key=key)


def test_look_up_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("tendero.llm.warc.BLOCK_LINES", 3)
    rows = [(k, f"http://h{k % 7}.example.com/{k % 40}", f"page {k}") for k in range(200)]
    directory = write_index(write_archive(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert directory.count() >= 60
    asked = [rows[3][1], rows[38][1], "http://nowhere.org/"]
    found = look_up(directory, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    assert sorted(r["page_id"] for r in found) == sorted(i for i, u, _ in rows if u in asked)


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archive(write_index(write_archive(none))).collect() == []
