"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines decides where a chunk ends, so an inserted
line moves only the chunks around it and a passage shared by two texts falls into the same
chunks in both.  Chunks of several lines that occur again, compared byte by byte, stay only
where they occur first.

Chunks leave the edges of a repeated passage and passages that hold no whole chunk.  An exact
completion follows: each pair of neighbouring lines that are not blank is looked up as well, where
no removed chunk holds it already.  A run of two such lines or more occurs earlier only if each of its
pairs, with the blank lines between, does, so no run is missed.  The first occurrence of a pair
never lies in a removed chunk, as the chunk's own first occurrence holds the pair earlier; leaving those
pairs out therefore loses nothing.  Blank lines alone are no evidence of a copy and never make a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import boxed, field_type, row_key, slices, stage, utf8

KEY = ["_ka", "_kb"]
_ALL = (1 << 64) - 1


def line_chunks(data: bytes, window: int = 2, divisor: int = 3) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) of each chunk of a text; lines count from 1.

    A buzhash of the last ``window`` line hashes, rotated and combined by exclusive or, ends a
    chunk when it is divisible by ``divisor``.
    """
    import xxhash

    lines = data.split(b"\n")
    recent: list[int] = []
    out, first = [], 0
    for at, line in enumerate(lines):
        recent = [*recent[1 - window :], xxhash.xxh64_intdigest(line, 42)] if window > 1 else [xxhash.xxh64_intdigest(line, 42)]
        rolled = 0
        for value in recent:
            rolled = ((rolled << 1 | rolled >> 63) & _ALL) ^ value
        if rolled % divisor == 0 or at == len(lines) - 1:
            out.append((first + 1, at + 1 - first, b"\n".join(lines[first : at + 1])))
            first = at + 1
    return out


def line_pairs(data: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) from each line that is not blank to the next such one; lines count from 1."""
    lines = data.split(b"\n")
    filled = [at for at, line in enumerate(lines) if line.strip()]
    return [(a + 1, b - a + 1, b"\n".join(lines[a : b + 1])) for a, b in zip(filled, filled[1:])]


def filled_chunks(data: bytes, window: int = 2, divisor: int = 3) -> list[tuple[int, int, bytes]]:
    """The chunks of a text that hold three filled lines or more, without blank lines at their ends.

    One of two filled lines is a pair of ``line_pairs``.
    """
    out = []
    for first, _, body in line_chunks(data, window, divisor):
        lines = body.split(b"\n")
        filled = [at for at, line in enumerate(lines) if line.strip()]
        if len(filled) > 2:
            a, b = filled[0], filled[-1] + 1
            out.append((first + a, b - a, b"\n".join(lines[a:b])))
    return out


Pieces = Callable[[bytes], list[tuple[int, int, bytes]]]


def _places(rows: DataFrame, chunks: Pieces, pairs: Pieces | None, min_lines: int) -> DataFrame:
    """(doc_id, _ka, _kb, first, size, hash, bytes, whole) of chunks (whole) and pairs of at least ``min_lines`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "text"):
            found = [
                (row, first, size, xxhash.xxh64_intdigest(body, 42), len(body), pieces is chunks)
                for row, data in enumerate(batch.column(3).to_pylist())
                for pieces in (chunks, pairs)
                if pieces is not None
                for first, size, body in pieces(data)
                if size >= min_lines
            ]
            row, first, size, digest, count, whole = (np.array(x, np.uint64) for x in (zip(*found) if found else [[]] * 6))
            kept = [batch.column(i).take(pa.array(row.astype(np.int64))) for i in range(3)]
            rest = [pa.array(x) for x in (first.astype(np.int32), size.astype(np.int32), digest.view(np.int64), count.astype(np.int32), whole.astype(bool))]
            yield pa.RecordBatch.from_arrays([*kept, *rest], names=["doc_id", *KEY, "first", "size", "hash", "bytes", "whole"])

    schema = f"doc_id {field_type(rows, 'doc_id')}, _ka long, _kb long, first int, size int, hash long, bytes int, whole boolean"
    return rows.select("doc_id", *KEY, utf8("text").alias("text")).mapInArrow(run, schema)


def _open_marks(first: np.ndarray, size: np.ndarray, owns: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which marks of one text to look up: all but later copies of pairs whose lines all lie in later copies of chunks."""
    ends = first + size
    covered = np.zeros(int(ends.max()) + 1, np.int64)
    for a, b in zip(first[whole & ~owns], ends[whole & ~owns]):
        covered[a:b] = 1
    held = np.concatenate([[0], np.cumsum(covered)])
    return owns | whole | (held[ends] - held[first] < size)


def _bodies(rows: DataFrame) -> DataFrame:
    """One row (_ka, _kb, first, size, hash, bytes, owns, whole, body) for each open mark in ``marks`` of a row's text."""
    names = ["first", "size", "hash", "bytes", "owns", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            marks = batch.column(3)
            counts = np.diff(marks.offsets.to_numpy())
            listed = marks.flatten()
            fields = [listed.field(name).to_numpy(zero_copy_only=False) for name in names]
            kept, bodies, start = [], [], 0
            for row, count in enumerate(counts.tolist()):
                first, size, _, _, owns, whole = (x[start : start + count] for x in fields)
                chosen = np.flatnonzero(_open_marks(first, size, owns, whole))
                lines = batch.column(2)[row].as_py().split(b"\n")
                bodies += [b"\n".join(lines[f - 1 : f - 1 + n]) for f, n in zip(first[chosen].tolist(), size[chosen].tolist())]
                kept.append(chosen + start)
                start += count
            at = np.concatenate(kept)
            keys = [batch.column(i).take(pa.array(np.repeat(np.arange(len(counts)), counts)[at])) for i in range(2)]
            taken = listed.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*keys, *[taken.field(x) for x in names], pa.array(bodies, pa.binary())], names=[*KEY, *names, "body"])

    schema = "_ka long, _kb long, first int, size int, hash long, bytes int, owns boolean, whole boolean, body binary"
    return rows.select(*KEY, utf8("text").alias("text"), "marks").mapInArrow(run, schema)


def repeated_chunks(
    docs: DataFrame,
    window: int = 2,
    divisor: int = 3,
    min_lines: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(_ka, _kb, first, size): chunks to be removed, by row key; the first occurrence is not among them.

    "First" is by document id (NULL last), then by content, then by line.
    """
    return _repeated(docs, lambda data: line_chunks(data, window, divisor), None, min_lines, doc_id, text)


def _repeated(docs: DataFrame, chunks: Pieces, pairs: Pieces | None, min_lines: int, doc_id: str, text: str) -> DataFrame:
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *row_key())
    long_enough = keyed.where(F.col("text").contains("\n"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *KEY, "first").alias("place")
    places = _places(long_enough, chunks, pairs, min_lines).select(place, "size", "hash", "bytes", "whole")
    places = stage(places, "line-chunks")
    same = ["hash", "bytes", "whole"]
    again = places.groupBy(*same).agg(F.min("place").alias("owner"), F.max("place").alias("latest"))
    again = stage(again.where("owner <> latest").select(*same, "owner"), "repeated-chunks")
    suspects = places.join(again, same).select(
        "place._ka", "place._kb", "place.first", "size", *same, (F.col("place") == F.col("owner")).alias("owns")
    )
    per_row = suspects.distinct().groupBy(*KEY).agg(
        F.collect_list(F.struct("first", "size", "hash", "bytes", "owns", "whole")).alias("marks")
    )
    # merged at every size: a plan that changes with the size of one side is hard to provision for
    marked = keyed.join(stage(per_row, "suspect-rows").hint("merge"), KEY)
    bodies = stage(_bodies(marked), "suspect-bodies")
    owned = bodies.where("owns").groupBy(*same).agg(F.first("body").alias("owned"))
    others = bodies.where("not owns").join(stage(owned, "owner-bodies"), same)
    return others.where(F.col("body") == F.col("owned")).select(*KEY, "first", "size").distinct()


def drop_repeated_chunks(
    docs: DataFrame,
    window: int = 2,
    divisor: int = 3,
    min_lines: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with repeated chunks cut out of ``text``, beside ``removed`` (array of (first, size)).

    All columns keep their names and values but ``text``.  NULL stays NULL; an empty or
    one-line text holds no chunk of several lines and stays as it is; a text whose chunks all
    stand elsewhere becomes empty, its row stays.  Rows that agree in id and text are treated
    alike.  The result is (_row, removed), to be opened with ``_row.*``.
    """
    gone = repeated_chunks(docs, window, divisor, min_lines, doc_id, text)
    removed = stage(gone.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "size"))).alias("removed")), "removed-chunks")
    return _cut(docs, removed, doc_id, text)


def _runs(found: pa.Array) -> pa.Array:
    """The runs (first, size) of lines that spans (first, size), sorted, cover."""
    out = []
    for spans in found.to_pylist():
        runs: list[list[int]] = []
        for span in spans:
            first, end = span["first"], span["first"] + span["size"]
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([first, end])
        out.append([{"first": a, "size": b - a} for a, b in runs])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32())])))


def drop_repeated_runs(
    docs: DataFrame, window: int = 2, divisor: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` without the lines of runs of two filled lines or more that occur earlier, beside ``removed``.

    Content-defined chunks that occur earlier go first; pairs of lines complete them at the edges.  All
    such runs go, with the blank lines inside, wherever they start and end; of every line that is removed an earlier
    copy stays.  The result does not depend on ``window`` and ``divisor``, only the work does.  Lines are removed after
    a comparison of bytes; should two different chunks agree in hash and length, the pairs inside the later one stay.
    "Earlier" and all else are as with ``drop_repeated_chunks``; ``removed`` has the longest runs of removed lines.
    """
    gone = _repeated(docs, lambda data: filled_chunks(data, window, divisor), line_pairs, 2, doc_id, text)
    runs = F.arrow_udf(_runs, "array<struct<first:int,size:int>>")
    spans = gone.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "size"))).alias("spans"))
    removed = spans.select(*KEY, runs("spans").alias("removed"))
    return _cut(docs, stage(removed, "removed-runs"), doc_id, text)


def _cut(docs: DataFrame, removed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_row, removed): the rows of ``docs`` without the lines of ``removed`` (_ka, _kb, removed)."""
    ka, kb = row_key(doc_id, text)
    rows = boxed(docs, _ka=ka, _kb=kb).join(removed.hint("merge"), KEY, "left")
    lines = F.split(F.col("_row").getField(text), "\n", -1)
    kept = F.filter(
        F.transform(lines, lambda line, i: F.struct(line.alias("line"), (i + 1).alias("at"))),
        lambda x: ~F.exists("removed", lambda r: (x["at"] >= r["first"]) & (x["at"] < r["first"] + r["size"])),
    )
    left = F.when(F.col("removed").isNull(), F.col("_row").getField(text)).otherwise(
        F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    )
    return rows.select(F.col("_row").withField(f"`{text}`", left).alias("_row"), "removed")
