"""URL functions against the standard library."""

from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from paperloom.functions.urls import (
    file_class,
    is_file_link,
    normalize_url,
    page_filename,
    parser_class,
    resolve_url,
    same_host,
    url_host,
    url_path,
    url_query,
)

BASES = ["http://h.example/a/b/c?q=1#f", "https://h.example", "http://h.example/", "http://u@h.example:80/x/", "http://h.example/a//b/c"]
HREFS = [
    "", "x", "./x", "../x", "../../../x", "/x/y", "/x/../y", "/./x/.", "..", ".", "../", "?p=2", "#top", "?p=2#z", "//o.example/z?y",
    "http://h.example/abs", "https://other.example/p/../q", "mailto:me@x.org", "javascript:void(0)", "x?y=../z", "a/b/../c/./d", "x/..",
    "/a//b", "x y",
]


def test_resolve_url_joins_like_the_standard_library(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    got = [r[0] for r in df.orderBy("i").select(resolve_url("b", "h")).collect()]
    wrong = [(b, h, g, urljoin(b, h)) for (b, h), g in zip(pairs, got) if g != urljoin(b, h)]
    assert not wrong


def test_parts(spark):
    urls = [*BASES, "/only/path?x", "not a url", "http://[::1]:8080/p?a=b#c"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    for row in df.select("u", url_host("u").alias("h"), url_path("u").alias("p"), url_query("u").alias("q")).collect():
        parsed = urlparse(row.u)
        assert (row.h, row.p, row.q) == (parsed.netloc, parsed.path, parsed.query)


def test_normalize_and_host(spark):
    df = spark.createDataFrame([("http://h/a?x#y", "http://h/z"), ("http://h/a#y?x", "http://h2/")], "u string, s string")
    got = df.select(normalize_url("u"), same_host("u", "s")).collect()
    assert [tuple(r) for r in got] == [("http://h/a", True), ("http://h/a", False)]


def test_file_rules(spark):
    cases = {
        "http://h/a.PDF": True, "http://h/a.pdf?x=1": True, "http://h/pdf": False, "http://h/a?doc=1": True,
        "http://h/a.txt": False, "http://h/a.html": False, "http://h/x.docx#frag": True,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", is_file_link("u")).collect()} == cases


def test_media_type_wins_over_suffix(spark):
    df = spark.createDataFrame(
        [("http://h/a.csv", "application/pdf"), ("http://h/a.XLS", "text/html"), ("http://h/a.txt", None), ("http://h/a", "x/y")],
        "u string, m string",
    )
    assert [r[0] for r in df.select(file_class("u", "m")).collect()] == ["pdf", "excel", "text", "others"]


def test_parser_class(spark):
    df = spark.createDataFrame([("a.DOC",), ("b.text",), ("c.tar.gz",), ("d",)], "p string")
    assert [r[0] for r in df.select(parser_class("p")).collect()] == ["docs", "text", None, None]


def test_page_filename(spark):
    df = spark.createDataFrame([("http://h/A/b-c.aspx",), ("http://h",), ("http://h/éß_1",)], "u string")
    assert [r[0] for r in df.select(page_filename("u", 2)).collect()] == ["_A_b_c_aspx_2", "index_2", "_éß_1_2"]
    assert F is not None
