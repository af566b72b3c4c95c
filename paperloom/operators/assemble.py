"""Ordered rows to documents, tables to text, nested JSON to lines: one row per document.

The rows of a document are joined in two steps, runs of ``RUN`` order values first, so the
last step sees few, already joined texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from paperloom.functions.text import clean_lines, row_line, trim_space

PAGE_MARK = "\n--- Page %d ---\n%s\n"  # fixed format
SHORT_PAGE = 10
RUN = 10_000


def assemble_lines(df: DataFrame, keys: Sequence[str], order: str, line: Column, sep: str = "\n") -> DataFrame:
    """Join ``line`` over the rows of each key in ``order``: keys, text."""
    keys = list(keys)
    at = F.col(order)
    run = F.floor(at / RUN) if isinstance(df.schema[order].dataType, NumericType) else F.lit(0)
    rows = df.select(*keys, run.alias("_run"), F.struct(at.alias("at"), line.alias("line")).alias("_row"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_row")), lambda r: r["line"]), sep)
    runs = rows.groupBy(*keys, "_run").agg(F.struct("_run", joined.alias("text")).alias("_part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("_part")), lambda r: r["text"]), sep)
    return runs.groupBy(*keys).agg(whole.alias("text"))


def assemble_pages(df: DataFrame, keys: Sequence[str], page_no: str, text: str) -> DataFrame:
    """Pages in order, each under a page mark, its text passed through ``clean_lines``."""
    page = F.format_string(PAGE_MARK, F.col(page_no), F.coalesce(clean_lines(F.col(text)), F.lit("")))
    return assemble_lines(df, keys, page_no, page, "")


def assemble_paragraphs(df: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Paragraphs in order, one per line, cleaned."""
    rows = df.withColumn("_line", clean_lines(F.col(text))).where(F.col("_line") != "")
    return assemble_lines(rows, keys, order, F.col("_line"), "\n")


def flag_short_pages(df: DataFrame, text: str) -> DataFrame:
    """Add ``needs_ocr``: no text, or fewer than ten characters."""
    short = F.coalesce(F.length(trim_space(F.col(text))), F.lit(0)) < SHORT_PAGE
    return df.withColumn("needs_ocr", short)


def rows_to_text(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    keys: Sequence[str] = (),
    header: bool = False,
) -> DataFrame:
    """A table as text: cells joined by a space, rows by a line break; ``keys`` name the document and sheet.

    With ``header`` each text starts with the column names and the lines are cleaned.
    """
    columns = list(columns)
    line = clean_lines(row_line(columns)) if header else row_line(columns)
    text = assemble_lines(df, list(keys), order, line)
    if not header:
        return text
    return text.withColumn("text", F.concat(F.lit(" ".join(columns) + "\n"), "text"))


def _leaves(value: object, path: str, compat: bool) -> Iterator[tuple[str, str]]:
    stack = [(path, value)]
    while stack:
        at, node = stack.pop()
        if isinstance(node, dict):
            children = list(node.items())
        elif isinstance(node, list):
            children = list(enumerate(node))
        else:
            yield at, str(node)
            continue
        for name, child in reversed(children):
            if not compat:
                step = f"{at}.{name}" if at else str(name)
            elif isinstance(node, dict) and not at:
                step = str(name)
            else:
                step = f"{at}{name}."
            stack.append((step, child))


_LEAF = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))


def flatten_json(df: DataFrame, column: str, keys: Sequence[str], compat: bool = False) -> DataFrame:
    """Depth-first leaves of a JSON column: keys, ord, path, value.  Malformed JSON has no leaves.

    Python's parser is used, as the leaf order is the document's key order at any
    depth and numbers keep their spelling rules; a VARIANT sorts its keys.
    ``compat`` gives the path spelling of the text form (no dot after a top-level
    key, a dot after every deeper one).
    """

    @F.arrow_udf("array<struct<path:string,value:string>>")
    def leaves(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                found = None if text is None else _leaves(json.loads(text), "", compat)
                out.append(found and [{"path": p, "value": v} for p, v in found])
            except (ValueError, RecursionError):  # deeper than the parser goes
                out.append(None)
        return pa.array(out, _LEAF)

    return (
        df.select(*keys, F.posexplode(leaves(column)).alias("ord", "_leaf"))
        .select(*keys, "ord", "_leaf.path", "_leaf.value")
    )


def flat_text(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The leaves as ``path: value`` lines per document."""
    line = clean_lines(F.concat_ws(": ", "path", "value"))
    return assemble_lines(leaves, keys, "ord", line, "\n")
