"""Rules and listed URLs against plain Python."""

import pytest

from tendero.llm.queries import RULES
from tendero.llm.url_filter import judge, tracked

PAGES = [
    (1, "https://www.Example.NET/en/1"), (2, "http://example.net/de/2"), (3, "https://a.example.com/de/3"), (4, "https://b.org/fr/x"),
    (5, "https://b.org/en/x?utm_source=1"), (6, "http://m.b.org/en/x/"), (7, "http://www.b.org/en/x.html#top"), (8, "http://b.org/en/xy"),
    (9, None), (10, "no scheme"), (11, ""), (12, "x://net/"), (13, "x://net"), (14, "x://notexample.com/de/"), (15, "x://h?a://b/c"),
    (16, "a\nb://Host.ORG\n/fr/"), (None, "http://b.org/en/x"), (5, "https://b.org/en/x?utm_source=1"), (17, "http://" + "h" * 5000 + ".com/"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]


def canonical(url):
    host, path = parts(url)
    for start in ("www.", "m."):
        if host.startswith(start):
            host = host[len(start):]
            break
    return host + (path[:-5] if path.endswith(".html") else path.rstrip("/"))


def test_verdicts(spark):
    pages = spark.createDataFrame([(*p, "x", True) for p in PAGES], "page_id long, url string, host string, hit boolean")
    listed = {canonical(u) for _, u in PAGES if u and "utm_source=" in u}
    wanted = []
    for i, url in PAGES:
        host, path = parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if canonical(url) in listed else "allow")
        wanted.append((i, host, path, rule, verdict))
    found = [tuple(r)[:5] for r in judge(pages, RULES, tracked(pages)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, wanted))


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_filter_lets_no_listed_url_through(spark, monkeypatch, bytes_):
    monkeypatch.setattr("tendero.llm.url_filter.BROADCAST_BYTES", bytes_)
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://a.com/', id) AS url")
    listed = pages.where("page_id % 3 = 0").selectExpr("concat('a.com/', page_id) AS canonical")
    found = judge(pages, (), listed)
    assert found.where("verdict = 'block'").count() == 1000 == found.where("verdict = 'block' AND page_id % 3 = 0").count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge(none, RULES, tracked(none)).collect() == []
