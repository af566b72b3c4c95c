"""Bounded reachability over a stored page corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import content_hash
from paperloom.functions.urls import PAGE_FILE_TYPES, is_file_link, normalize_url, resolve_url, same_host
from paperloom.operators.dedupe import dedupe_keep_first
from paperloom.operators.pages import filter_allowed, html_links
from paperloom.plans.materialize import materialize
from paperloom.plans.project import with_column_once

FOLD_ROUNDS = 16  # rounds after which the written rounds are merged into one table
_VISIT = "seed string, url string, depth int, content_hash string"


def _page_links(pages: DataFrame, rules: DataFrame | None, agent: str | None, keep: Sequence[str]) -> DataFrame:
    """(url, target, variant, *keep) of same-host page links, URLs normalised; ``variant`` is the page's own URL."""
    links = with_column_once(html_links(pages, "html", ["url", *keep]), "link", resolve_url("url", "href"))
    links = links.where(same_host("link", "url"))
    if rules is not None:
        links = filter_allowed(links, rules, "link", agent)
    links = links.where(~is_file_link("link", PAGE_FILE_TYPES))
    links = links.select(normalize_url("url").alias("url"), normalize_url("link").alias("target"), F.col("url").alias("variant"), *keep)
    return links.where(F.col("url") != F.col("target"))


def link_table(pages: DataFrame, rules: DataFrame | None = None, agent: str | None = None) -> DataFrame:
    """Distinct ``(url, target)`` of same-host page links, URLs normalised."""
    return _page_links(pages, rules, agent, []).select("url", "target").distinct()


def crawl_reach(
    pages: DataFrame, seeds: DataFrame, rules: DataFrame | None = None, agent: str | None = None
) -> DataFrame:
    """``(seed, url, depth, content_hash)`` of the pages each seed reaches breadth-first.

    ``pages``: url, html.  ``seeds``: url, depth (NULL for no limit).  A page whose
    content a seed has already seen is skipped and its links are not followed; of
    equal pages the smallest (depth, url) stays.  A seed that is a file link is not a page.  Every round reads written tables
    only.  Several stored variants of a normalised URL count once.
    """
    spark = pages.sparkSession
    # hashes and links leave each page's row first; only these small rows are compared
    hashed = pages.select("url", "html", content_hash("html").alias("content_hash"))
    variants = hashed.select(normalize_url("url").alias("url"), F.col("url").alias("full_url"), "content_hash")
    stored = materialize(dedupe_keep_first(variants, ["url"], ["full_url", "content_hash"]), "hashes")
    hashes = stored.select("url", "content_hash")
    chosen = stored.select(F.col("full_url").alias("variant"), "content_hash")
    links = _page_links(hashed, rules, agent, ["content_hash"]).join(chosen, ["variant", "content_hash"], "left_semi")
    links = materialize(links.select("url", "target").distinct(), "links")
    start = seeds.select(
        F.col("url").alias("seed"),
        normalize_url("url").alias("url"),
        F.col("depth").cast("int").alias("limit"),
    ).where((F.col("limit").isNull() | (F.col("limit") >= 0)) & ~is_file_link("seed", PAGE_FILE_TYPES))
    frontier = materialize(start.distinct(), "frontier")
    met = frontier.select("seed", "url")  # every URL ever put on a frontier
    visited = spark.createDataFrame([], _VISIT)
    depth = 0
    while frontier.take(1):
        found = frontier.join(hashes, "url")
        fresh = found.join(visited.select("seed", "content_hash"), ["seed", "content_hash"], "left_anti")
        fresh = materialize(dedupe_keep_first(fresh, ["seed", "content_hash"], ["url"]), "visit")
        visited = visited.unionByName(
            fresh.select("seed", "url", F.lit(depth).alias("depth"), "content_hash")
        )
        onward = fresh.where(F.col("limit").isNull() | (F.col("limit") > depth)).select("seed", "limit", "url")
        step = onward.join(links, "url").select("seed", F.col("target").alias("url"), "limit").distinct()
        step = step.where(same_host("url", "seed"))
        frontier = materialize(step.join(met, ["seed", "url"], "left_anti"), "frontier")
        met = met.unionByName(frontier.select("seed", "url"))
        depth += 1
        if depth % FOLD_ROUNDS == 0:
            visited, met = materialize(visited, "visited"), materialize(met, "met")
    return visited
