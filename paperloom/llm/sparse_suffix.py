"""Repeated passages by a sparse suffix array.

Suffixes are kept only where a word position is the minimiser of a window, so two texts that
share a passage keep the same positions in it.  With ``least`` words to find and windows of
``window`` positions, a passage holds a minimiser among its first ``window`` positions, and at
least ``least - window + 1`` words of it follow: the seed.  Suffixes whose seed occurs nowhere
else leave early.  The rest are sorted by the words that follow, and those that may share
still more by the words before, both times range-partitioned, and each is compared with its
neighbours.  A match is extended to the right by the words in common, up to ``least`` in all,
and to the left by up to ``window - 1``; as kept positions are at most ``window`` apart, these
reach the ends of any passage, and longer ones are put together from overlapping matches.

A passage that stands in two places, or that has ``least + window - 1`` words or more, is always
found.  A shorter one with further, partly overlapping occurrences is missed only if, at each
of its positions, other texts share more words to the right and others more to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom.llm.common import field_type, slices, stage, utf8
from paperloom.llm.words import BASE, NOT_SPACE, hashed_words, joined, mixed, powers

TEXT = ["_ta", "_tb"]
SUFFIX = "seed binary, after binary, before binary, doc binary, place int"
SUFFIX_NAMES = ["seed", "after", "before", "doc", "place"]
MATCH = "doc binary, begin int, stop int, match binary, match_begin int"
MATCH_NAMES = ["doc", "begin", "stop", "match", "match_begin"]
SLICE_BYTES = 1 << 20
WINDOW_ROWS = 1 << 16
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every position; the last ``size - 1`` positions have none."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(n)[:n], out=total[1:], dtype=np.uint64)
    back = np.full(n, INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back, dtype=np.uint64)
    return mixed((total[size:] - total[:-size]) * back[: n - size + 1])


def minimisers(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions with the least gram hash of some window of one text, leftmost on ties, in order."""
    order = _gram_hashes(words, gram)
    if len(order) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(order, window)
    picked = [views[a : a + WINDOW_ROWS].argmin(axis=1) + np.arange(a, min(a + WINDOW_ROWS, len(views))) for a in range(0, len(views), WINDOW_ROWS)]
    return np.unique(np.concatenate(picked))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    data = utf8(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"), data.alias("text"), F.xxhash64(data).alias("_ta"), F.xxhash64(F.lit(1), data).alias("_tb")
    )


def seeds(docs: DataFrame, least: int, gram: int, window: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written rows (doc_id, _ta, _tb, n_words, places, keys): kept positions of each text and the hash of their seed words."""
    seed = least - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, bounds = joined(batch.column(1).to_pylist())
            starts, _, words = hashed_words(data, NOT_SPACE)
            cuts = np.searchsorted(starts, bounds)
            places, keys = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < least:
                    places.append(np.zeros(0, np.int64))
                    keys.append(np.zeros(0, np.uint64))
                    continue
                at = minimisers(words[a:b], gram, window)
                at = at[at + seed <= b - a]
                places.append(at)
                keys.append(_gram_hashes(words[a:b], seed)[at])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    batch.column(3),
                    pa.array(np.diff(cuts).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64))),
                ],
                names=["doc_id", *TEXT, "n_words", "places", "keys"],
            )

    schema = f"doc_id {field_type(docs, doc_id)}, _ta long, _tb long, n_words int, places array<int>, keys array<long>"
    return stage(_texts(docs, doc_id, text).mapInArrow(run, schema), "suffix-seeds")


def _suffixes(docs: DataFrame, marks: DataFrame, least: int, window: int, doc_id: str, text: str) -> DataFrame:
    """(seed, after, before, doc, place) of marked positions.

    ``seed`` is the digest of the words every passage here must share, ``after`` the words that
    follow them, ``before`` the words ahead of the position in reverse.
    """
    size = least - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "text", SLICE_BYTES):
            rows, places, seed, after, before = [], [], [], [], []
            for row, (data, marked) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                words = data.split()
                for at in sorted(set(marked)):
                    rows.append(row)
                    places.append(at)
                    seed.append(xxhash.xxh3_128_digest(b" ".join(words[at : at + size])))
                    after.append(b" ".join(words[at + size : at + least]))
                    before.append(b" ".join(reversed(words[max(0, at - window + 1) : at])))
            columns = [pa.array(c, pa.binary()) for c in (seed, after, before)]
            doc = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, doc, pa.array(places, pa.int32())], names=SUFFIX_NAMES)

    rows = _texts(docs, doc_id, text).join(marks.hint("merge"), TEXT).where(F.col("doc_id").eqNullSafe(F.col("owner")))
    return rows.select(_name().alias("doc"), "text", "marked").mapInArrow(run, SUFFIX)


def _common(a: bytes, b: bytes) -> int:
    """Number of leading words in common."""
    if a == b:
        return a.count(b" ") + 1 if a else 0
    n = 0
    for x, y in zip(a.split(b" ") if a else [], b.split(b" ") if b else []):
        if x != y:
            break
        n += 1
    return n


def _meet(one: tuple, other: tuple, least: int, size: int) -> tuple[int, int] | None:
    """(words in common before, from the position on) of two suffixes, if together at least ``least``."""
    if one[0] != other[0] or one[3:] == other[3:]:  # no seed in common, or a repeated row
        return None
    after = size + _common(one[1], other[1])
    before = _common(one[2], other[2])
    return (before, after) if before + after >= least else None


def _match(one: tuple, found: list[tuple[tuple[int, int], tuple]]) -> tuple:
    """One row over all that ``one`` shares with its neighbours; the match is the one that begins first."""
    doc, place = one[3:]
    (before, _), other = max(found, key=lambda f: f[0][0])
    return doc, place - before, place + max(after for (_, after), _ in found), other[3], other[4] - before


def _neighbours(suffixes: DataFrame, order: list[str], least: int, size: int) -> DataFrame:
    """What each suffix, sorted by ``order``, shares with the ones beside it.

    Written rows of three sorts: matches (doc, begin, stop, match, match_begin); ``again``, the
    suffixes that may still share more with others, that is all but those whose context equals
    a neighbour's; and per partition its ``first`` and ``last`` suffix as a boundary record.
    """
    row = f"struct<{', '.join(c.replace(' ', ':') for c in SUFFIX.split(', '))}>"
    schema = f"{MATCH}, again {row}, part int, first {row}, last {row}"
    ordered = suffixes.repartitionByRange(*order, "doc", "place").sortWithinPartitions(*order, "doc", "place")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(**columns: list) -> pa.RecordBatch:
        n = max(map(len, columns.values()))
        return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in target}, schema=target)

    def matches(found: list[tuple]) -> pa.RecordBatch:
        return arrow(**dict(zip(MATCH_NAMES, map(list, zip(*found)))))

    def as_rows(found: list[tuple]) -> list[dict]:
        return [dict(zip(SUFFIX_NAMES, x)) for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        shared: list = []  # of the held suffix with the one ahead of it
        for batch in batches:
            found, open_ended = [], []
            for one in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                first = first or one
                met = _meet(held, one, least, size) if held else None
                if met:
                    shared.append((met, one))
                if held and shared:
                    found.append(_match(held, shared))
                if not (met and one[1:3] == held[1:3]):
                    open_ended.append(one)
                shared = [(met, held)] if met else []
                held = one
            if found:
                yield matches(found)
            if open_ended:
                yield arrow(again=as_rows(open_ended))
        if held:
            if shared:
                yield matches([_match(held, shared)])
            yield arrow(part=[TaskContext.get().partitionId()], first=as_rows([first]), last=as_rows([held]))

    return stage(ordered.select(*SUFFIX_NAMES).mapInArrow(run, schema), "suffix-matches")


def _matches(found: DataFrame, least: int, size: int) -> DataFrame:
    """All matches of one order: those inside partitions, and of the last suffix of each with the first of the next."""
    edges = found.where("part is not null").select("last", F.lead("first").over(Window.orderBy("part")).alias("next"))
    target = to_arrow_schema(StructType.fromDDL(MATCH))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[tuple(x[k] for k in SUFFIX_NAMES) for x in batch.column(i).to_pylist()] for i in range(2)]
            met = [(a, b, _meet(a, b, least, size)) for a, b in zip(*sides)]
            rows = [r for a, b, m in met if m for r in (_match(a, [(m, b)]), _match(b, [(m, a)]))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_pydict(dict(zip(MATCH_NAMES, map(list, columns))), schema=target)

    inside = found.where("doc is not null").select(*MATCH_NAMES)
    return inside.unionByName(edges.where("next is not null").mapInArrow(across, MATCH))


def _merged(matches: DataFrame) -> DataFrame:
    """(doc, begin, stop, match, match_begin): overlapping matches of a text as one; groups are as long as a text."""
    ordered = Window.partitionBy("doc").orderBy("begin", F.desc("stop"), "match", "match_begin")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = matches.withColumn("opens", (reach.isNull() | (F.col("begin") > reach)).cast("int"))
    numbered = opens.withColumn("number", F.sum("opens").over(ordered))
    first = F.struct("begin", F.negative("stop").alias("stop"), "match", "match_begin")
    merged = numbered.groupBy("doc", "number").agg(F.max("stop").alias("stop"), F.min(first).alias("f"))
    return merged.select("doc", "f.begin", "stop", "f.match", "f.match_begin")


def _name() -> Column:
    """The 16 bytes of a text's two hashes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in TEXT])


def repeated_passages(
    docs: DataFrame, least: int = 50, gram: int = 8, window: int = 16, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, start_word, n_words, match_doc_id, match_start_word): passages of ``least`` words or more that occur again.

    Words stand between ASCII white space and are compared byte by byte.  Overlapping passages
    of a document are one row, whose match is the one that begins first.  Equal texts are one
    text here: each of its documents has one row over the whole text, matched with the least
    id, and that one with the greatest; the passages that such a text shares with others are
    rows of the others.  A passage may repeat within one document.

    NULL and short texts have no rows; repeated rows are equal texts; a NULL id is an id;
    an empty table gives no rows; other columns are not read.
    """
    rows = seeds(docs, least, gram, window, doc_id, text)
    # one of the two hashes will do to find candidates; the other joins below
    keyed = rows.select("_ta", F.explode(F.arrays_zip("keys", "places")).alias("s")).select(
        F.col("s.keys").alias("key"), "_ta", F.col("s.places").alias("place")
    )
    often = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "seed-keys")
    shared = stage(keyed.join(often, "key").distinct(), "shared-seeds")  # copies of a text give one row
    again = stage(shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    owners = rows.groupBy(*TEXT).agg(
        F.min("doc_id").alias("owner"),
        F.max("doc_id").alias("latest"),
        F.count("*").alias("copies"),
        F.first("n_words").alias("n_words"),
    )
    owners = stage(owners, "text-owners")
    marked = shared.join(again, "key").groupBy("_ta").agg(F.collect_list("place").alias("marked"))
    marks = stage(marked.join(owners.select(*TEXT, "owner"), "_ta"), "marked-texts")
    size = least - window + 1
    # by the words after, then by the words before: the longest match to either side is a neighbour
    forward = _neighbours(_suffixes(docs, marks, least, window, doc_id, text), ["seed", "after", "before"], least, size)
    rest = forward.where("again is not null").select("again.*")
    backward = _neighbours(rest, ["seed", "before", "after"], least, size)
    spans = _merged(_matches(forward, least, size).unionByName(_matches(backward, least, size)))
    single = owners.where("copies = 1").select(_name().alias("doc"), F.col("owner").alias("doc_id"))
    named = owners.select(_name().alias("match"), F.col("owner").alias("match_doc_id"))
    parts = spans.join(single, "doc").join(named, "match")
    copied = owners.where((F.col("copies") > 1) & (F.col("n_words") >= least)).drop("n_words")
    whole = rows.select("doc_id", *TEXT, "n_words").join(copied, TEXT)
    return parts.select(
        "doc_id",
        F.col("begin").alias("start_word"),
        (F.col("stop") - F.col("begin")).alias("n_words"),
        "match_doc_id",
        F.col("match_begin").alias("match_start_word"),
    ).unionByName(
        whole.select(
            "doc_id",
            F.lit(0).alias("start_word"),
            "n_words",
            F.when(F.col("doc_id").eqNullSafe(F.col("owner")), F.col("latest")).otherwise(F.col("owner")).alias("match_doc_id"),
            F.lit(0).alias("match_start_word"),
        )
    )
