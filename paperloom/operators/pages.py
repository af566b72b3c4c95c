"""Stored web pages: titles, links, text blocks, element trees, robots rules."""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.functions.text import NO_TITLE
from paperloom.plans.project import with_column_once
from paperloom.functions.urls import base_name, is_file_link, normalize_url, resolve_url, same_host, url_host, url_path

# --- fixed values: must equal the expected output ---------------------------------
BLOCK_TAGS = (
    "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main",
    "aside", "header", "footer", "nav", "ul", "ol", "li", "table",
)
REMOVED_TAGS = ("script", "style", "meta", "link")
LINK_LABEL = "Download"
TEXT_HEAD = "URL: %s\nTitle: %s\n"
TREE_HEAD = "URL: %s\nDomain: %s\nTitle: %s\n"
# -----------------------------------------------------------------------------------

PIECE_BYTES = 1 << 18  # of pages that a task walks at a time

# HTML elements that never have content (HTML Living Standard, with the obsolete ones)
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
_NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"']+)"""
_OTHER_ATTRIBUTES = r"""(?:\s+(?!href\s*=)[^\s=>"']+(?:\s*=\s*""" + _VALUE + r""")?)*+"""
_ANCHOR = r"(?is)<a" + _OTHER_ATTRIBUTES + r"\s+href\s*=\s*(" + _VALUE + ")"
_ANCHOR_WITH_TEXT = _ANCHOR + r"""[^>]*>(.*?)(?=</a\s*>|<a\s|\z)"""


def _decode(texts: pa.Array) -> pa.Array:
    return pa.array([t and (html_entities.unescape(t) if "&" in t else t) for t in texts.to_pylist()], pa.string())


def unescape(text: Column | str) -> Column:
    """Decode character references; Spark has no builtin for the full table."""
    return F.arrow_udf(_decode, "string")(text)


def html_title(html: Column | str) -> Column:
    """The first title, character references decoded, or a fixed text."""
    html = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<title[^>]*>(.*?)</title"), F.lit(1))
    return F.coalesce(unescape(F.get(found, F.lit(0))), F.lit(NO_TITLE))


def html_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Every ``<a href>``: keep, ord, href.  A regexp scan in the JVM; only the hrefs go through Arrow."""
    quoted = F.regexp_extract_all(F.regexp_replace(html, _NOT_MARKUP, ""), F.lit(_ANCHOR), F.lit(1))
    hrefs = F.transform(quoted, lambda h: F.regexp_replace(h, r"""^["']|["']\z""", ""))
    out = pages.select(*keep, F.posexplode(hrefs).alias("ord", "_raw"))
    return out.select(*keep, "ord", unescape("_raw").alias("href"))


def expand_links(pages: DataFrame, html: str = "html", url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Links resolved against their page, kept when on the same host and not the page itself."""
    links = html_links(pages, html, [*keep, url])
    links = with_column_once(links, "target", normalize_url(resolve_url(url, "href")))
    return links.where(same_host("target", url) & (F.col("target") != normalize_url(url)))


def file_links(
    pages: DataFrame, html: str = "html", url: str = "url", keep: Sequence[str] = ("page_id",), resolve_first: bool = True
) -> DataFrame:
    """Links to files: keep, ord, file_url, label (link text, else base name, else a fixed word)."""
    clean = F.regexp_replace(html, _NOT_MARKUP, "")
    quoted = F.regexp_extract_all(clean, F.lit(_ANCHOR_WITH_TEXT), F.lit(1))
    texts = F.regexp_extract_all(clean, F.lit(_ANCHOR_WITH_TEXT), F.lit(2))
    pairs = F.arrays_zip(quoted.alias("href"), texts.alias("text"))
    out = pages.select(*keep, url, F.posexplode(pairs).alias("ord", "_link"))
    bare = F.regexp_replace(F.col("_link")["href"], r"""^["']|["']\z""", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("_link")["text"], r"(?s)<[^>]*>", ""), r"(?U)\s+", " "))
    out = out.select(*keep, "ord", url, unescape(bare).alias("_href"), unescape(text).alias("_text"))
    out = with_column_once(out, "file_url", resolve_url(url, "_href")).where(is_file_link("file_url"))
    label = F.coalesce(F.nullif("_text", F.lit("")), F.nullif(base_name("file_url"), F.lit("")), F.lit(LINK_LABEL))
    return out.select(*keep, "ord", "file_url", label.alias("label"))


class _Walk(HTMLParser):
    """Collects elements in document order; tags left open stay open until an ancestor closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.fragments: list[str] = []
        self.elements: list[dict] = []
        self.stack: list[dict] = []
        self.removed = 0
        self.title: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = {"tag": tag, "depth": len(self.stack), "start": len(self.fragments), "end": None, "attrs": dict(attrs)}
        element["removed"] = self.removed > 0 or tag in REMOVED_TAGS
        if not element["removed"]:
            self.elements.append(element)
        if tag in VOID_TAGS:
            element["end"] = element["start"]
            return
        self.stack.append(element)
        self.removed += tag in REMOVED_TAGS
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if all(e["tag"] != tag for e in self.stack):
            return
        while self.stack:
            element = self.stack.pop()
            element["end"] = len(self.fragments)
            self.removed -= element["tag"] in REMOVED_TAGS
            self.in_title = self.in_title and element["tag"] != "title"
            if element["tag"] == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if not self.removed:
            self.fragments.append(data)


def walk_html(html: str) -> dict:
    """Title and elements ``(ord, depth, tag, id, classes, attrs, text, in_body, first)``, scripts and styles removed.

    ``text`` is that of the whole subtree, white space collapsed.  ``first`` marks the
    first block element of the page that carries its text.
    """
    parser = _Walk()
    parser.feed(html)
    parser.close()
    seen: set[str] = set()
    rows, body = [], None
    for at, element in enumerate(parser.elements):
        end = len(parser.fragments) if element["end"] is None else element["end"]
        text = re.sub(r"\s+", " ", "".join(parser.fragments[element["start"] : end])).strip()
        if body is None and element["tag"] == "body":
            body = (at, element["depth"], element["end"])
        first = element["tag"] in BLOCK_TAGS and bool(text) and text not in seen
        if first:
            seen.add(text)
        attrs = {k: " ".join(v.split()) if k == "class" and v else (v or "") for k, v in element["attrs"].items()}
        rows.append(
            {
                "ord": at,
                "depth": element["depth"],
                "tag": element["tag"],
                "id": attrs.pop("id", None) or None,
                "classes": attrs.pop("class", None) or None,
                "attrs": attrs,
                "text": text,
                "in_body": False,
                "first": first,
            }
        )
    below = False
    for row in rows:  # body and everything nested in it; the whole page where there is no body
        if body is not None:
            below = row["ord"] >= body[0] and (row["ord"] == body[0] or (below and row["depth"] > body[1]))
        row["in_body"] = body is None or below
    title = None if parser.title is None else "".join(parser.title)
    return {"title": title, "elements": rows}


_ELEMENT = (
    "struct<ord:int,depth:int,tag:string,id:string,classes:string,attrs:map<string,string>,"
    "text:string,in_body:boolean,first:boolean>"
)
_PAGE_TYPE = pa.struct(
    [
        ("title", pa.string()),
        (
            "elements",
            pa.list_(
                pa.struct(
                    [
                        ("ord", pa.int32()),
                        ("depth", pa.int32()),
                        ("tag", pa.string()),
                        ("id", pa.string()),
                        ("classes", pa.string()),
                        ("attrs", pa.map_(pa.string(), pa.string())),
                        ("text", pa.string()),
                        ("in_body", pa.bool_()),
                        ("first", pa.bool_()),
                    ]
                )
            ),
        ),
    ]
)


def _walk_batch(htmls: pa.Array) -> pa.Array:
    pages = []
    for text in htmls.to_pylist():
        page = walk_html(text or "")
        for element in page["elements"]:
            element["attrs"] = list(element["attrs"].items())
        pages.append(page)
    return pa.array(pages, _PAGE_TYPE)


def _in_pieces(batch: pa.RecordBatch, html: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``PIECE_BYTES`` of pages, or one page: the texts of nested elements take a multiple of it."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(html)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def parse_pages(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """keep, title, elements; the operators below are projections of it, with no shuffle."""
    keep = list(keep)
    given = pages.select(F.col(html).cast("string").alias("_html"), *keep)
    page = StructType.fromDDL(f"_page struct<title:string,elements:array<{_ELEMENT}>>")
    schema = StructType([*page.fields, *given.schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _in_pieces(batch, 0):
                walked = _walk_batch(piece.column(0))
                yield pa.RecordBatch.from_arrays([walked, *piece.columns[1:]], names=["_page", *piece.schema.names[1:]])

    parsed = given.mapInArrow(run, schema)
    return parsed.select(*keep, F.coalesce("_page.title", F.lit(NO_TITLE)).alias("title"), "_page.elements")


def html_blocks(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Text of each block element in document order, first occurrence of a text only: keep, ord, tag, text."""
    blocks = F.filter("elements", lambda e: e["first"])
    out = parse_pages(pages, html, keep).select(*keep, F.explode(blocks).alias("_e"))
    return out.select(*keep, "_e.ord", "_e.tag", "_e.text")


def html_to_text(pages: DataFrame, html: str = "html", url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep, text: URL line, title line, then the blocks separated by blank lines."""
    blocks = F.transform(F.filter("elements", lambda e: e["first"]), lambda e: F.concat(F.lit("\n"), e["text"]))
    text = F.concat(F.format_string(TEXT_HEAD, url, "title"), F.array_join(blocks, "\n"))
    return parse_pages(pages, html, [*keep, url]).select(*keep, text.alias("text"))


def html_tree(
    pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",), attrs: bool = False
) -> DataFrame:
    """Elements of the body, depth-first: keep, ord, depth, tag, id, classes, [attrs], text."""
    inside = F.filter("elements", lambda e: e["in_body"])
    out = parse_pages(pages, html, keep).select(*keep, F.explode(inside).alias("_e"))
    fields = ["ord", "depth", "tag", "id", "classes", *(["attrs"] if attrs else []), "text"]
    return out.select(*keep, *[f"_e.{f}" for f in fields])


def html_detailed(pages: DataFrame, html: str = "html", url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The element tree as indented lines, one document per page."""
    inside = F.filter("elements", lambda e: e["in_body"])
    top = F.array_min(F.transform(inside, lambda e: e["depth"]))

    def lines(e: Column) -> Column:
        pad = F.repeat(F.lit(" "), 2 * (e["depth"] - top))
        ident = F.coalesce(F.concat(F.lit(' id="'), e["id"], F.lit('"')), F.lit(""))
        classes = F.coalesce(F.concat(F.lit(' class="'), e["classes"], F.lit('"')), F.lit(""))
        head = F.concat(pad, F.lit("<"), e["tag"], ident, classes, F.lit(">"))
        return F.when(e["text"] == "", head).otherwise(F.concat(head, F.lit("\n"), pad, F.lit("  TEXT: "), e["text"]))

    head = F.format_string(TREE_HEAD + "\n", F.col(url), url_host(url), F.col("title"))
    text = F.concat(head, F.array_join(F.transform(inside, lines), "\n"))
    return parse_pages(pages, html, [*keep, url]).select(*keep, text.alias("text"))


def _decoded(path: Column) -> Column:
    """Escapes resolved, an empty query or fragment dropped; both sides of a comparison are brought to this form."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(plain, r"\??#?\z", "")


def filter_allowed(urls: DataFrame, rules: DataFrame, url: str = "url", agent: str | None = None) -> DataFrame:
    """Keep URLs their host allows: the first rule whose prefix starts path and query wins, default allow.

    ``rules``: host, ord, prefix, allow and, optionally, agent (NULL or ``*`` for all) and
    group.  An agent follows one group: of those that name it, that is whose agent occurs in
    the text before its first ``/``, the one with the least group number (without numbers, the
    least ord), else the rules for all.  Escapes count as the characters they stand for, ``*``
    matches every path and an empty disallowed prefix allows everything.

    A host's rules become one ordered array, so the join has one row per host and
    emits no rule pairs; a host with many URLs is met map-side when the host table
    is small and otherwise split by adaptive skew handling.
    """
    if "agent" in rules.columns and agent is not None:
        token = agent.split("/")[0].lower()
        everyone = rules.where(F.col("agent").isNull() | (F.col("agent") == "*"))
        named = rules.where((F.col("agent") != "*") & F.lit(token).contains(F.lower("agent")))
        if "group" not in rules.columns:
            starts = named.groupBy("host", F.lower("agent").alias("_agent")).agg(F.min("ord").alias("group"))
            named = named.withColumn("_agent", F.lower("agent")).join(starts, ["host", "_agent"]).drop("_agent")
        first = named.groupBy("host").agg(F.min("group").alias("group"))
        columns = ["host", "ord", "prefix", "allow"]
        own = named.join(first, ["host", "group"], "left_semi").select(*columns)
        rules = own.unionByName(everyone.join(first, "host", "left_anti").select(*columns))
    prefix = F.when(F.col("prefix") == "*", "").otherwise(_decoded(F.col("prefix"))).alias("prefix")
    allow = (F.col("allow") | (F.col("prefix") == "")).alias("allow")
    ordered = rules.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("ord", prefix, allow))).alias("_rules"))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(?s)(.*)\z", 1)
    path = _decoded(F.when(rest == "", "/").otherwise(rest))
    rows = urls.withColumn("_path", path).withColumn("_host", url_host(url))
    joined = rows.join(ordered.withColumnRenamed("host", "_host"), "_host", "left")
    verdict = F.get(F.filter("_rules", lambda r: F.col("_path").startswith(r["prefix"])), F.lit(0))["allow"]
    return joined.where(F.coalesce(verdict, F.lit(True))).select(*urls.columns)
