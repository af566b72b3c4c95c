"""URL functions: lenient generic-syntax parsing with native regexps, no per-row Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the expected output ---------------------------------
LINK_FILE_TYPES = ("pdf", "csv", "xlsx", "xls", "json", "docx", "doc")
PAGE_FILE_TYPES = ("pdf", "csv", "xlsx", "xls", "json", "docx", "doc", "txt")
CONTENT_TYPE_EXTENSION = {
    "application/pdf": "pdf",
    "text/csv": "csv",
    "application/csv": "csv",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/json": "json",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
}
EXTENSION_CLASS = {
    "pdf": "pdf",
    "csv": "csv",
    "xlsx": "excel",
    "xls": "excel",
    "json": "json",
    "docx": "docs",
    "doc": "docs",
    "txt": "text",
}
PARSER_CLASS = {**EXTENSION_CLASS, "text": "text"}
OTHER_CLASS = "others"
# -----------------------------------------------------------------------------------

# generic URI syntax (RFC 3986, appendix B): 2 scheme, 3 //authority, 4 authority, 5 path, 6 ?query, 7 query, 8 #fragment
_PARTS = r"(?s)^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?"


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(_col(url), _PARTS, group)


def url_scheme(url: Column | str) -> Column:
    return F.lower(_part(url, 2))


def url_host(url: Column | str) -> Column:
    """Authority part, with any user info and port."""
    return _part(url, 4)


def url_path(url: Column | str) -> Column:
    return _part(url, 5)


def url_query(url: Column | str) -> Column:
    return _part(url, 7)


def normalize_url(url: Column | str) -> Column:
    """Drop the query and the fragment."""
    return F.regexp_replace(_col(url), r"(?s)[?#].*\z", "")


def _fold_dots(path: Column, keep_empty: Column) -> Column:
    """Resolve ``.`` and ``..`` segments and drop empty inner ones."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    inner = F.filter(F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0))), lambda s: (s != "") | keep_empty)
    folded = F.aggregate(
        F.concat(inner, F.array(last)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(folded, "/"), tail)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Join a link with the URL of the page that holds it."""
    base, href = _col(base), F.trim(_col(href))
    base_scheme = _part(base, 2)
    site = F.concat(base_scheme, F.lit("://"), url_host(base))
    base_path = url_path(base)
    path, tail = url_path(href), F.concat(_part(href, 6), F.regexp_replace(_part(href, 8), r"^#\z", ""))
    base_folder = F.regexp_replace(base_path, r"(?s)[^/]*\z", "")
    merged = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(base_folder == "", F.lit("/")).otherwise(base_folder), path)
    )
    own_scheme = (_part(href, 1) != "") & (url_scheme(href) != F.lower(base_scheme))
    return (
        F.when(href == "", base)
        .when(own_scheme, href)
        .when(_part(href, 3) != "", F.concat(base_scheme, F.lit("://"), url_host(href), path, tail))
        .when(path == "", F.concat(site, base_path, F.when(_part(href, 6) == "", _part(base, 6)).otherwise(F.lit("")), tail))
        .when(
            path.startswith("/") & ~path.contains("/."),
            F.concat(site, path, tail),
        )
        .otherwise(F.concat(site, _fold_dots(merged, path.startswith("/")), tail))
    )


def same_host(url: Column | str, seed: Column | str) -> Column:
    return url_host(url) == url_host(seed)


def is_file_link(url: Column | str, file_types: Sequence[str] = LINK_FILE_TYPES) -> Column:
    """The path ends in a known extension, or the query contains one anywhere."""
    types = "|".join(file_types)
    return F.lower(url_path(url)).rlike(rf"\.({types})\z") | F.lower(url_query(url)).rlike(types)


def file_extension(url: Column | str, content_type: Column | str | None = None) -> Column:
    """Extension by media type, else by path suffix, else ``others``."""
    suffix = F.regexp_extract(F.lower(url_path(url)), r"\.(%s)\z" % "|".join(PAGE_FILE_TYPES), 1)
    by_path = F.when(suffix != "", suffix)
    if content_type is None:
        return F.coalesce(by_path, F.lit(OTHER_CLASS))
    media = F.lower(_col(content_type))
    by_media = F.create_map(*[F.lit(x) for kv in CONTENT_TYPE_EXTENSION.items() for x in kv])[media]
    return F.coalesce(by_media, by_path, F.lit(OTHER_CLASS))


def file_class(url: Column | str, content_type: Column | str | None = None) -> Column:
    """The folder class a downloaded file belongs to."""
    classes = F.create_map(*[F.lit(x) for kv in EXTENSION_CLASS.items() for x in kv])
    return F.coalesce(classes[file_extension(url, content_type)], F.lit(OTHER_CLASS))


def parser_class(path: Column | str) -> Column:
    """Which parser a stored file goes to, by its extension; NULL when unsupported."""
    suffix = F.regexp_extract(F.lower(_col(path)), r"\.([a-z]+)\z", 1)
    return F.create_map(*[F.lit(x) for kv in PARSER_CLASS.items() for x in kv])[suffix]


def page_filename(url: Column | str, depth: Column | int) -> Column:
    """Path with every non-word character replaced, plus the depth."""
    path = url_path(url)
    depth = F.lit(depth) if isinstance(depth, int) else depth
    stem = F.when(path == "", F.lit("index")).otherwise(F.regexp_replace(path, r"[^\p{L}\p{N}_]", "_"))
    return F.concat(stem, F.lit("_"), depth.cast("string"))


def base_name(url: Column | str) -> Column:
    return F.regexp_extract(url_path(url), r"([^/]*)\z", 1)
