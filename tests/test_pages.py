import pytest
from pyspark.sql import functions as F

from paperloom.operators.crawl import crawl_reach
from paperloom.operators.pages import (
    file_links,
    filter_allowed,
    html_blocks,
    html_detailed,
    html_links,
    html_title,
    html_to_text,
    html_tree,
    walk_html,
)

NESTED = (
    "<html><head><title>T &amp; U</title><style>p{}</style></head><body><div id=d class='a  b'>one <p>two"
    "<script>var t='</p>';</script><p>three</div><p>two</p><!-- no --><br><p> </p></body></html>"
)


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(htmls)], "page_id int, url string, html string")


def test_blocks_keep_nesting_and_first_texts(spark):
    rows = html_blocks(pages(spark, NESTED)).orderBy("ord").collect()
    # an open <p> stays open, so the second one is nested in the first
    assert [(r.tag, r.text) for r in rows] == [("div", "one twothree"), ("p", "twothree"), ("p", "three"), ("p", "two")]


def test_page_text(spark):
    rows = html_to_text(pages(spark, NESTED, "<b>no blocks</b>")).orderBy("page_id").collect()
    assert rows[0].text == "URL: http://h/0\nTitle: T & U\n\none twothree\n\ntwothree\n\nthree\n\ntwo"
    assert rows[1].text == "URL: http://h/1\nTitle: No title found\n"


def test_tree_starts_at_the_body(spark):
    rows = html_tree(pages(spark, NESTED), attrs=True).orderBy("ord").collect()
    assert [r.tag for r in rows] == ["body", "div", "p", "p", "p", "br", "p"]
    div = rows[1]
    assert (div.id, div.classes, div.attrs, div.depth - rows[0].depth) == ("d", "a b", {}, 1)
    assert rows[2].depth == div.depth + 1 and rows[3].depth == div.depth + 2


def test_tree_without_a_body_is_the_whole_page(spark):
    rows = html_tree(pages(spark, "<p title='x'>a</p>b<i>c</i>"), attrs=True).collect()
    assert [(r.tag, r.attrs, r.text) for r in rows] == [("p", {"title": "x"}, "a"), ("i", {}, "c")]


def test_detailed_lines(spark):
    text = html_detailed(pages(spark, "<body><div id=q class=z><b>x</b></div><hr></body>")).first().text
    assert text == (
        "URL: http://h/0\nDomain: h\nTitle: No title found\n\n<body>\n  TEXT: x\n  <div id=\"q\" class=\"z\">\n    TEXT: x\n"
        "    <b>\n      TEXT: x\n  <hr>"
    )


def test_walk_survives_broken_markup():
    for html in ("", "<", "</p></div>text", "<p", "<a href=", "<![CDATA[x]]>", "<p>&bogus;&#x41;", "<div><div><div>"):
        assert isinstance(walk_html(html)["elements"], list)
    assert walk_html("<p>&bogus;&#x41;</p>")["elements"][0]["text"] == "&bogus;A"


def test_titles(spark):
    got = [r[0] for r in pages(spark, "<title lang=x>A&nbsp;&lt;b&gt;</title><title>2</title>", "x", "<!-- <title>c</title> --><TITLE>D</TITLE>").select(html_title("html")).collect()]
    assert got == ["A\xa0<b>", "No title found", "D"]


def test_links(spark):
    html = (
        "<a href=\"/x?a=1&amp;b=2\">1</a><A class=c HREF='y z'>2</a><a name=n>3</a><a data-href='no' href=plain>4</a>"
        "<!-- <a href='comment'> --><script>'<a href=\"script\">'</script><abbr href=q><a\nhref = \"/last\">"
    )
    assert [r.href for r in html_links(pages(spark, html)).orderBy("ord").collect()] == ["/x?a=1&b=2", "y z", "plain", "/last"]


def test_file_link_labels(spark):
    html = "<a href='/d/a.pdf'><b>The</b>\n report</a><a href='b.CSV'></a><a href='?get=json'> </a><a href='/no.html'>n</a>"
    rows = file_links(pages(spark, html)).orderBy("ord").collect()
    assert [(r.file_url, r.label) for r in rows] == [
        ("http://h/d/a.pdf", "The report"), ("http://h/b.CSV", "b.CSV"), ("http://h/0?get=json", "0"),
    ]


def test_first_matching_rule_wins(spark):
    urls = spark.createDataFrame([(u,) for u in ("http://h/a/b", "http://h/a", "http://h/c", "http://h", "http://o/a")], "url string")
    rules = spark.createDataFrame(
        [("h", 2, "/a", False, None), ("h", 1, "/a/b", True, "*"), ("h", 3, "/c", False, "otherbot"), ("h", 4, "/", True, None)],
        "host string, ord int, prefix string, allow boolean, agent string",
    )
    got = lambda agent: sorted(r.url for r in filter_allowed(urls, rules, agent=agent).collect())
    assert got("mybot") == ["http://h", "http://h/a/b", "http://h/c", "http://o/a"]
    # an agent with rules of its own follows only those
    assert got("OtherBot/1.0") == ["http://h", "http://h/a", "http://h/a/b", "http://o/a"]


def test_robots_rules_like_the_standard_parser(spark):
    from urllib.robotparser import RobotFileParser

    groups = [("foo", [("/search", False)]), ("foobar", [("/", False)]), ("bot", [("/b", True), ("/", False)]),
              ("*", [("/search?", False), ("/a%20b", False), ("/caf\u00e9", False), ("", False)])]
    lines, rows = [], []
    for number, (agent, entries) in enumerate(groups):
        lines += [f"User-agent: {agent}", *[f"{'Allow' if ok else 'Disallow'}: {path}" for path, ok in entries], ""]
        rows += [("h", number, 10 * number + i, path, ok, agent) for i, (path, ok) in enumerate(entries)]
    parser = RobotFileParser()
    parser.parse(lines)
    paths = ["", "/", "/search", "/search?q=1", "/a b", "/a%20b/c", "/caf%C3%A9", "/b/x", "/x?y#z"]
    rules = spark.createDataFrame(rows, "host string, group int, ord int, prefix string, allow boolean, agent string")
    urls = spark.createDataFrame([(f"http://h{p}",) for p in paths], "url string")
    for agent in ("foobar/1", "FooBar", "Mozilla/5.0 (bot)", "mybot/2", "other"):
        got = {r.url for r in filter_allowed(urls, rules, agent=agent).collect()}
        assert got == {f"http://h{p}" for p in paths if parser.can_fetch(agent, f"http://h{p}")}, agent


SITE = [
    ("http://a/x", "<a href='y?q=1'>y</a><a href='/z/'>z</a><a href='http://b/q'>b</a><a href='/f.pdf'>f</a>"),
    ("http://a/y", "same<a href='../x'>x</a> <a href='w'>w</a>"),
    ("http://a/z/", "<a href='./p'>p</a>"),
    ("http://a/z/p", "same<a href='../x'>x</a> <a href='w'>w</a>"),
    ("http://a/w", "end"),
    ("http://b/q", "<a href='http://a/x'>back</a>"),
    ("http://a/f.pdf", "file"),
]


@pytest.fixture()
def site(spark):
    return spark.createDataFrame(SITE, "url string, html string")


def visits(spark, site, seeds, **kw):
    seeds = spark.createDataFrame(seeds, "url string, depth int")
    return sorted((r.seed, r.url, r.depth) for r in crawl_reach(site, seeds, **kw).collect())


def test_crawl_depths_duplicates_and_hosts(spark, site):
    got = visits(spark, site, [("http://a/x", None), ("http://a/x?s", 1), ("http://b/q", 0), ("http://a/none", 3)])
    a = "http://a/x"
    # /z/p repeats the content of /y, which is nearer, so it is skipped; files and other hosts are not followed
    assert got == sorted(
        [(a, a, 0), (a, "http://a/y", 1), (a, "http://a/z/", 1), (a, "http://a/w", 2)]
        + [("http://a/x?s", a, 0), ("http://a/x?s", "http://a/y", 1), ("http://a/x?s", "http://a/z/", 1)]
        + [("http://b/q", "http://b/q", 0)]
    )


def test_crawl_respects_rules_and_partitioning(spark, site, partitions):
    rules = spark.createDataFrame([("a", 1, "/y", False)], "host string, ord int, prefix string, allow boolean")
    want = [("http://a/x", "http://a/x", 0), ("http://a/x", "http://a/z/", 1), ("http://a/x", "http://a/z/p", 2), ("http://a/x", "http://a/z/w", 3)]
    for n in (1, 8):
        partitions(n)
        # links on /z/p lead to /x, seen before, and to /z/w, which is not stored
        assert visits(spark, site, [("http://a/x", None)], rules=rules) == want[:3]


def test_link_scan_stays_in_the_jvm_but_for_the_hrefs(spark, site):
    links = html_links(site.withColumn("page_id", F.lit(1)))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_file_link_is_no_seed(spark, site):
    assert visits(spark, site, [("http://a/f.pdf", None)]) == []
