"""CSV with quoted line breaks, read by as many tasks as a file has splits.

A task that starts in the middle of a file cannot know whether it is inside quotes.  The first pass
tells for every split how a quote that is open, or not, at its start stands at its end; the driver chains these
answers, one per split, in file order.  The second pass then knows where each split's first record begins.
Records inside a split leave as they are; the few that cross a split are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")')
_HIDDEN = "_split_{}"


def still_quoted(line: str, quoted: bool) -> bool:
    """Whether a quote is open after ``line``, given whether one was before.

    A quote opens only at the start of a field; two quotes inside are one; what follows the closing
    quote up to the comma belongs to the field.
    """
    at = 0
    if quoted:
        close = _CLOSE.match(line)
        if close is None:
            return True
        at = line.find(",", close.end()) + 1
        if not at:
            return False
    elif not line.startswith('"'):
        at = line.find(',"') + 1
        if not at:
            return False
    while True:
        if line.startswith('"', at):
            close = _CLOSE.match(line, at + 1)
            if close is None:
                return True
            at = line.find(",", close.end()) + 1
        else:
            at = line.find(',"', at) + 1
        if not at:
            return False


@dataclass
class Split:
    """What a split does with an open quote (``after[1]``) or none (``after[0]``), and whether a record begins in it then."""

    file: str
    start: int
    after: tuple[bool, bool]
    begins: tuple[bool, bool]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line) in the order of the file within every split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _survey(lines: DataFrame) -> list[Split]:
    """One entry per split, from the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_split, state, begins = None, [False, True], [False, False]

        def entry() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": open_split[0], "start": open_split[1], "after": state, "begins": begins}], schema)

        for batch in batches:
            for file, start, line in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (file, start) != open_split:
                    if open_split is not None:
                        yield entry()
                    open_split, state, begins = (file, start), [False, True], [False, False]
                begins = [b or not s for b, s in zip(begins, state)]
                if '"' in line:
                    state = [still_quoted(line, s) for s in state]
        if open_split is not None:
            yield entry()

    flags = pa.list_(pa.bool_())
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("after", flags), ("begins", flags)])
    found = lines.mapInArrow(run, "file string, start long, after array<boolean>, begins array<boolean>")
    return [Split(r.file, r.start, tuple(r.after), tuple(r.begins)) for r in found.collect()]  # one row per split, as the driver plans them


def chained(splits: list[Split]) -> dict[tuple[str, int], tuple[bool, int]]:
    """(file, start) -> (a quote is open at the start, start of the split in which the record open there begins)."""
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    file, quoted, owner = None, False, 0
    for split in sorted(splits, key=lambda s: (s.file, s.start)):
        if split.file != file:
            file, quoted, owner = split.file, False, split.start
        out[split.file, split.start] = quoted, owner
        if split.begins[quoted]:
            owner = split.start
        quoted = split.after[quoted]
    return out


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of every record but the header of each file; empty lines are none."""
    lines = _lines(spark, path)
    begins = chained(_survey(lines))
    first = {file: min(s for f, s in begins if f == file) for file, _ in begins}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_split, quoted, owner, held, header = None, False, 0, [], False
        done: list[dict] = []

        def close(whole: bool) -> None:
            """Let the lines held go: a record of its own, or a part of one that crosses splits."""
            nonlocal held, header
            if held and whole and header:
                header = False
            elif held and (not whole or held != [""]):
                done.append({"file": open_split[0], "owner": None if whole else owner, "part": open_split[1], "record": "\n".join(held), "head": header})
            held = []

        for batch in batches:
            for file, start, line in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (file, start) != open_split:
                    if open_split is not None:
                        # a record that ends with its split is whole, unless its beginning stands elsewhere
                        close(not quoted and owner == open_split[1])
                    open_split = file, start
                    quoted, owner = begins[open_split]
                    header = first[file] == start
                if not quoted:
                    close(owner == start or not held)
                    owner = start
                held.append(line)
                if '"' in line:
                    quoted = still_quoted(line, quoted)
                if not quoted and held[-1].endswith("\r"):
                    held[-1] = held[-1][:-1]
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
        if open_split is not None:
            close(not quoted and owner == open_split[1])
            yield pa.RecordBatch.from_pylist(done, schema)

    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("part", pa.int64()), ("record", pa.string()), ("head", pa.bool_())])
    found = lines.mapInArrow(run, "file string, owner long, part long, record string, head boolean")
    parts = found.where("owner is not null").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("part", "record"))).alias("parts"), F.max("head").alias("head")
    )
    joined = parts.where("not head").select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return found.where("owner is null").select("record").unionByName(joined)


def read_csv_splits(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV file or folder with the columns of ``schema``, or all as text and named by the header of its first file.

    Line breaks may stand inside quotes; a row with fewer fields ends with NULLs, further fields are dropped.
    """
    if schema is None:
        schema = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).schema
    names = [_HIDDEN.format(i) for i in range(len(schema))]
    if not names:
        return spark.createDataFrame([], schema)
    fields = ", ".join(f"{n} {field.dataType.simpleString()}" for n, field in zip(names, schema))
    options = {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = csv_records(spark, path).select(F.from_csv("record", fields, options).alias("r"))
    return parsed.select(*[F.col(f"r.{n}").alias(field.name) for n, field in zip(names, schema)])
