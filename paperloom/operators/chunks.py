"""Documents to chunks, and the chain that links neighbouring chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import fixed_slices

# --- fixed values: must equal the expected output ---------------------------------
FIXED_SIZE = 1500
RECURSIVE_SIZE = 500
RECURSIVE_OVERLAP = 50
SEPARATORS = ("\n\n", "\n", " ", "")
NEXT_CHUNK = "next_chunk"
# -----------------------------------------------------------------------------------


def _explode_chunks(df: DataFrame, pieces, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(pieces).alias("chunk_id", "text"))


def chunk_fixed(df: DataFrame, text: str = "text", keep: Sequence[str] = ("source",), size: int = FIXED_SIZE) -> DataFrame:
    """Consecutive slices of ``size`` code points of the whitespace-collapsed text: keep, chunk_id, text."""
    return _explode_chunks(df, fixed_slices(F.col(text), size), keep)


def _pieces(text: str, separator: str) -> Iterator[str]:
    """Cut in front of every separator, which stays at the head of the next piece."""
    if not separator:
        yield from text
        return
    cuts = [0, *(m.start() for m in re.finditer(re.escape(separator), text)), len(text)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield text[start:end]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces greedily up to ``size``; the next chunk opens with a tail of at most ``overlap``."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def split_recursive(
    text: str,
    size: int = RECURSIVE_SIZE,
    overlap: int = RECURSIVE_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> list[str]:
    """Split on the first separator that occurs, pack short pieces, split long ones by the next separators."""

    def walk(part: str, level: int) -> Iterator[str]:
        while level < len(separators) - 1 and separators[level] not in part:
            level += 1
        small: list[str] = []
        for piece in _pieces(part, separators[level]):
            if len(piece) < size:
                small.append(piece)
                continue
            yield from _pack(small, size, overlap)
            small = []
            if level + 1 < len(separators):
                yield from walk(piece, level + 1)
            else:
                yield piece
        yield from _pack(small, size, overlap)

    return [chunk for chunk in (c.strip() for c in walk(text, 0)) if chunk] if text else []


def chunk_recursive(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("source",),
    size: int = RECURSIVE_SIZE,
    overlap: int = RECURSIVE_OVERLAP,
) -> DataFrame:
    """Separator-aware chunks with overlap: keep, chunk_id, text.  Ids restart at 0 per document."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([split_recursive(t or "", size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return _explode_chunks(df, split(text), keep)


def next_chunk_edges(
    chunks: DataFrame,
    key: str = "source",
    chunk_id: str = "chunk_id",
    contiguous: bool = False,
    bucket_rows: int = 10_000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Edges ``(key, *keep, src, dst, relation)`` from each chunk to the following one of the same document.

    The predecessor is looked up inside id buckets, and a bucket's first chunk takes the last id of the
    nearest earlier bucket, so no document is sorted in one task.  With
    ``contiguous``, for whole tables from the chunkers above, whose ids run from 0
    without gaps, an edge is a projection of its later chunk: no shuffle.
    """
    at = F.col(chunk_id)
    if contiguous:
        edges = chunks.where(at > 0).select(key, *keep, (at - 1).alias("src"), at.alias("dst"))
    else:
        rows = chunks.select(key, *keep, at.alias("dst"), F.floor(at / bucket_rows).alias("_b"))
        previous = F.lag("dst").over(Window.partitionBy(key, "_b").orderBy("dst"))
        last_before = F.lag("_last").over(Window.partitionBy(key).orderBy("_b"))
        first = [F.min_by(c, "dst").alias(c) for c in keep]
        ends = rows.groupBy(key, "_b").agg(F.max("dst").alias("_last"), F.min("dst").alias("dst"), *first)
        heads = ends.select(key, *keep, "dst", last_before.alias("src"))
        inner = rows.select(key, *keep, "dst", previous.alias("src"))
        edges = inner.unionByName(heads).where(F.col("src").isNotNull()).select(key, *keep, "src", "dst")
    return edges.withColumn("relation", F.lit(NEXT_CHUNK))
