"""URLs, stored pages, routing, robots rules and reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from paperloom.functions.text import content_hash
from paperloom.functions.urls import (
    CONTENT_TYPE_EXTENSION,
    EXTENSION_CLASS,
    file_class,
    is_file_link,
    normalize_url,
    page_filename,
    parser_class,
    resolve_url,
    same_host,
    url_host,
)
from paperloom.operators.crawl import crawl_reach, link_table
from paperloom.operators.pages import (
    expand_links,
    file_links,
    filter_allowed,
    html_blocks,
    html_detailed,
    html_links,
    html_title,
    html_to_text,
    html_tree,
)
from paperloom.plans.materialize import checkpoint_dir
from paperloom.plans.project import spread
from paperloom.sources.tables import read_urls, write_by_class

HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(
    rf"""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS normalized, {HOST} AS host,
        CASE WHEN {PATH} = '' THEN 'index' ELSE regexp_replace({PATH}, '[^\p{{L}}\p{{N}}_]', '_', 'g') END || '_' || (page_id % 4) AS file_name,
        regexp_matches(lower({PATH}), '\.(pdf|csv|xlsx|xls|json|docx|doc)$')
          OR regexp_matches(lower(regexp_extract(url, '\?([^#]*)', 1)), 'pdf|csv|xlsx|xls|json|docx|doc') AS is_file,
        md5(html) AS content_hash
        FROM pages"""
)
def url_functions(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        normalize_url("url").alias("normalized"),
        url_host("url").alias("host"),
        page_filename("url", F.col("page_id") % 4).alias("file_name"),
        is_file_link("url").alias("is_file"),
        content_hash("html").alias("content_hash"),
    )


LINKS = r"regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
DECODED = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(
    f"""SELECT page_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS ord, {DECODED.format('unnest(l)')} AS href
        FROM (SELECT page_id, {LINKS} AS l FROM pages)""",
    name="html_links",
)
def html_links_query(spark, sf):
    return html_links(spread(table(spark, sf, "pages")), "html", ["page_id"])


@query(
    f"""SELECT page_id, {DECODED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages""",
    name="html_title",
)
def html_title_query(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", html_title("html").alias("title"))


# hrefs of every kind: the page id picks the shape of the links of a page
def _shaped_pages(spark, sf):
    shapes = F.array(
        F.lit("/$1"), F.lit("$1.pdf"), F.lit("//files.example.org/$1.CSV?x=1"), F.lit("https://other.example.org/a/$1#top"),
        F.lit("?doc=$1"), F.lit("#$1"), F.lit("../up/./$1.json"),
    )
    shape = F.element_at(shapes, F.expr("cast(page_id % 7 + 1 as int)"))
    html = F.regexp_replace("html", F.lit('<a href="/([^"]*)"'), F.concat(F.lit('<a href="'), shape, F.lit('"')))
    return spread(table(spark, sf, "pages")).select("page_id", "url", html.alias("html"))


SHAPED_SQL = rf"""raw AS (SELECT page_id, url, unnest(range(0, len(l))) AS ord, {DECODED.format('unnest(l)')} AS word
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS l FROM pages)),
  parts AS (SELECT *, regexp_extract(url, '^[a-z]+:', 0) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site,
    {PATH} AS path, regexp_extract(url, '^([^#]*)', 1) AS no_fragment FROM raw),
  dirs AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM parts),
  ups AS (SELECT *, CASE WHEN dir IN ('', '/') THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END AS up FROM dirs),
  resolved AS (SELECT page_id, url, ord, word, CASE page_id % 7
    WHEN 0 THEN site || '/' || word
    WHEN 1 THEN site || CASE WHEN dir = '' THEN '/' ELSE dir END || word || '.pdf'
    WHEN 2 THEN scheme || '//files.example.org/' || word || '.CSV?x=1'
    WHEN 3 THEN 'https://other.example.org/a/' || word || '#top'
    WHEN 4 THEN site || path || '?doc=' || word
    WHEN 5 THEN no_fragment || '#' || word
    ELSE site || up || 'up/' || word || '.json' END AS link FROM ups)"""


@query(
    f"""WITH {SHAPED_SQL} SELECT page_id, CAST(ord AS INTEGER) AS ord, link FROM resolved""",
    name="resolve_links",
)
def resolve_links_query(spark, sf):
    links = html_links(_shaped_pages(spark, sf), "html", ["page_id", "url"])
    return links.select("page_id", "ord", resolve_url("url", "href").alias("link"))


@query(
    rf"""WITH {SHAPED_SQL}, targets AS (SELECT *, regexp_replace(link, '[?#].*$', '') AS target FROM resolved)
    SELECT page_id, CAST(ord AS INTEGER) AS ord, target FROM targets
    WHERE regexp_extract(target, '^[a-z]+://([^/?#]*)', 1) = {HOST} AND target <> regexp_replace(url, '[?#].*$', '')""",
    name="expand_links",
)
def expand_links_query(spark, sf):
    return expand_links(_shaped_pages(spark, sf)).select("page_id", "ord", "target")


@query(
    rf"""WITH {SHAPED_SQL}
    SELECT page_id, CAST(ord AS INTEGER) AS ord, link AS file_url,
      word AS label FROM resolved
    WHERE regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\.(pdf|csv|xlsx|xls|json|docx|doc)$')
      OR regexp_matches(lower(regexp_extract(link, '\?([^#]*)', 1)), 'pdf|csv|xlsx|xls|json|docx|doc')""",
    name="file_links",
)
def file_links_query(spark, sf):
    return file_links(_shaped_pages(spark, sf))


@query(
    rf"""WITH {SHAPED_SQL}, targets AS (SELECT DISTINCT regexp_replace(link, '[?#].*$', '') AS target, {HOST} AS h FROM resolved),
    kept AS (SELECT target FROM targets WHERE regexp_extract(target, '^[a-z]+://([^/?#]*)', 1) = h)
    SELECT DISTINCT target FROM kept WHERE target NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages)""",
    name="unvisited_links",
)
def unvisited_links_query(spark, sf):
    pages = _shaped_pages(spark, sf)
    links = expand_links(pages).select("target").distinct()
    visited = table(spark, sf, "pages").select(normalize_url("url").alias("target"))
    return links.join(visited, "target", "left_anti")


def _routed(spark, sf):
    suffixes = F.array(*[F.lit(s) for s in (".pdf", ".CSV", ".xlsx", ".xls", ".json", ".doc", ".DOCX", ".txt", ".text", ".html", "")])
    media = F.array(*[F.lit(m) for m in (*CONTENT_TYPE_EXTENSION, "text/html", "application/octet-stream")])
    url = F.concat(normalize_url("url"), F.element_at(suffixes, F.expr("cast(page_id % 11 + 1 as int)")))
    kind = F.when(F.col("page_id") % 3 > 0, F.element_at(media, F.expr(f"cast(page_id % {len(CONTENT_TYPE_EXTENSION) + 2} + 1 as int)")))
    return table(spark, sf, "pages").select("page_id", url.alias("url"), kind.alias("content_type"))


_SUFFIX_SQL = "['.pdf','.CSV','.xlsx','.xls','.json','.doc','.DOCX','.txt','.text','.html','']"
_MEDIA_SQL = "[" + ",".join(f"'{m}'" for m in (*CONTENT_TYPE_EXTENSION, "text/html", "application/octet-stream")) + "]"
_BY_MEDIA = "CASE content_type " + " ".join(f"WHEN '{m}' THEN '{e}'" for m, e in CONTENT_TYPE_EXTENSION.items()) + " END"
_CLASS = "CASE {0} " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in EXTENSION_CLASS.items()) + " ELSE 'others' END"
ROUTED_SQL = rf"""routed AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || {_SUFFIX_SQL}[page_id % 11 + 1] AS url,
    CASE WHEN page_id % 3 > 0 THEN {_MEDIA_SQL}[page_id % {len(CONTENT_TYPE_EXTENSION) + 2} + 1] END AS content_type FROM pages),
  classed AS (SELECT *, coalesce({_BY_MEDIA}, nullif(regexp_extract(lower({PATH}), '\.(pdf|csv|xlsx|xls|json|docx|doc|txt)$', 1), '')) AS ext,
    regexp_extract(lower(url), '\.([a-z]+)$', 1) AS suffix FROM routed)"""


@query(
    f"""WITH {ROUTED_SQL} SELECT page_id, {_CLASS.format('ext')} AS file_class,
        CASE WHEN suffix = 'text' THEN 'text' ELSE nullif({_CLASS.format('suffix')}, 'others') END AS parser FROM classed"""
)
def route_by_type(spark, sf):
    return _routed(spark, sf).select(
        "page_id", file_class("url", "content_type").alias("file_class"), parser_class("url").alias("parser")
    )


@query(
    f"""WITH {ROUTED_SQL} SELECT page_id, url, {_CLASS.format('ext')} AS file_class FROM classed
        WHERE {_CLASS.format('ext')} = 'excel'"""
)
def stored_by_class(spark, sf):
    """Written one folder per class, read back with the other classes pruned."""
    import uuid

    path = f"{checkpoint_dir(spark)}/by-class-{uuid.uuid4().hex}"
    write_by_class(_routed(spark, sf).select("page_id", "url", file_class("url", "content_type").alias("file_class")), path)
    return spark.read.parquet(path).where(F.col("file_class") == "excel")


@query(
    rf"""WITH p AS (SELECT page_id, url, {HOST} AS host, {PATH} AS path FROM pages)
    SELECT page_id, url FROM p WHERE CASE
      WHEN starts_with(host, 'm.') THEN true
      WHEN starts_with(path, '/en/1') THEN true
      WHEN starts_with(path, '/en') THEN false
      WHEN starts_with(path, '/fr/') AND starts_with(host, 'blog.') THEN false ELSE true END""",
    name="filter_allowed",
)
def filter_allowed_query(spark, sf):
    """Rules are derived for every host that has pages; mobile hosts have none."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    hosts = pages.select(url_host("url").alias("host")).distinct().where(~F.col("host").startswith("m."))
    rule = lambda o, p, a: F.struct(F.lit(o).alias("ord"), F.lit(p).alias("prefix"), a.alias("allow"))
    rules = hosts.select(
        "host",
        F.inline(
            F.array(
                rule(3, "/fr/", ~F.col("host").startswith("blog.")),
                rule(1, "/en/1", F.lit(True)),
                rule(2, "/en", F.lit(False)),
            )
        ),
    )
    return filter_allowed(pages, rules)


@query(
    """WITH lines AS (SELECT page_id, url || ',' || CASE WHEN page_id % 4 = 3 THEN 'none' ELSE CAST(page_id % 4 AS VARCHAR) END AS line FROM pages)
    SELECT string_split(line, ',')[1] AS url, TRY_CAST(trim(string_split(line, ',')[2]) AS INTEGER) AS depth FROM lines""",
    name="read_urls",
)
def read_urls_query(spark, sf):
    depth = F.expr("CASE WHEN page_id % 4 = 3 THEN 'none' ELSE cast(page_id % 4 as string) END")
    lines = table(spark, sf, "pages").select(F.concat("url", F.lit(", "), depth, F.lit(" ")).alias("value"))
    return read_urls(lines)


@query(name="html_blocks")
def html_blocks_query(spark, sf):
    return html_blocks(spread(table(spark, sf, "pages")))


@query(name="html_to_text")
def html_to_text_query(spark, sf):
    return html_to_text(spread(table(spark, sf, "pages")))


@query(name="html_tree")
def html_tree_query(spark, sf):
    tree = html_tree(spread(table(spark, sf, "pages")), attrs=True)
    return tree.withColumn("attrs", F.to_json("attrs"))


@query(name="html_detailed")
def html_detailed_query(spark, sf):
    return html_detailed(spread(table(spark, sf, "pages")))


# every stored page becomes a node of a binary tree on one of five sites
def _site_pages(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    site, at = F.col("page_id") % 5, F.floor(F.col("page_id") / 5)
    links = F.concat(
        F.lit('<a href="/'), 2 * at + 1, F.lit('#top">l</a><a href="'), 2 * at + 2, F.lit('?r=1">r</a><a href="http://s'),
        (site + 1) % 5, F.lit('.example.org/0">o</a>'),
    )
    url = F.concat(F.lit("http://s"), site, F.lit(".example.org/"), at)
    return pages.select("page_id", url.alias("url"), F.concat("html", links).alias("html"))


SITE_SQL = """site AS (SELECT page_id, page_id % 5 AS s, page_id // 5 AS i, 'http://s' || (page_id % 5) || '.example.org/' || (page_id // 5) AS url,
    md5(html || '<a href="/' || (2 * (page_id // 5) + 1) || '#top">l</a><a href="' || (2 * (page_id // 5) + 2)
      || '?r=1">r</a><a href="http://s' || ((page_id % 5 + 1) % 5) || '.example.org/0">o</a>') AS content_hash FROM pages)"""


@query(
    f"""WITH {SITE_SQL} SELECT 'http://s' || s || '.example.org/0' AS seed, url, CAST(floor(log2(i + 1)) AS INTEGER) AS depth, content_hash
    FROM site WHERE s >= 3 OR floor(log2(i + 1)) <= s + 1""",
    name="crawl_reach",
)
def crawl_reach_query(spark, sf):
    """Seeds are the roots; three sites are depth-limited, two are not."""
    pages = _site_pages(spark, sf)
    limit = F.expr("CASE WHEN page_id < 3 THEN cast(page_id + 1 as int) END")
    seeds = pages.where("page_id < 5").select("url", limit.alias("depth"))
    return crawl_reach(pages.select("url", "html"), seeds)


@query(
    f"""WITH {SITE_SQL} SELECT url, 'http://s' || s || '.example.org/' || c AS target
    FROM (SELECT url, s, unnest([2 * i + 1, 2 * i + 2]) AS c FROM site)
    UNION SELECT s.url, 'http://s' || s || '.example.org' || {DECODED.format('href')} FROM site s
    JOIN (SELECT page_id, unnest({LINKS}) AS href FROM pages) l USING (page_id)""",
    name="link_table",
)
def link_table_query(spark, sf):
    return link_table(_site_pages(spark, sf).select("url", "html"))


@query(
    rf"""SELECT a.page_id, {HOST} = (SELECT regexp_extract(b.url, '^[a-z]+://([^/?#]*)', 1) FROM pages b WHERE b.page_id = 0) AS same FROM pages a"""
    .replace(HOST, HOST.replace("url", "a.url")),
    name="same_host",
)
def same_host_query(spark, sf):
    pages = table(spark, sf, "pages")
    seed = pages.where("page_id = 0").select("url").scalar()
    return pages.select("page_id", same_host("url", seed).alias("same"))
