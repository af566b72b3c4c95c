"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a task lays its documents out in one space of word
positions and writes segments of bounded size, each with its sorted terms and, per term,
the sorted positions.  A search takes the phrases in blocks of bounded size to the
segments.  In a segment the postings of a phrase's rarest term are moved back by the term's
offset; what is left after intersecting with the other terms' lists, rarest first, is where
the phrase occurs.  Postings are written once and never shuffled.

Terms are 64-bit hashes of words; two different words share one with a chance of 2**-64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import boxed, field_type, slices, stage, unboxed, utf8
from paperloom.llm.words import ALPHANUMERIC, LOWER, hashed_words, joined

SEGMENT_WORDS = 400_000
PHRASES_PER_BLOCK = 100_000
INDEX_BYTES = 1 << 20

INDEX_SCHEMA = (
    "segment long, doc_ids array<{id}>, doc_starts binary, doc_words binary, "
    "terms binary, list_starts binary, positions binary"
)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written segments of about ``SEGMENT_WORDS`` words (one document at least).

    Positions of neighbouring documents leave a gap of one, so no phrase crosses it.  NULL
    text has no words; its document is in the index all the same.
    """
    id_type = field_type(docs, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        counts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            starts = np.cumsum(words + 1) - (words + 1)
            terms_at = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            place = np.arange(len(terms_at)) + np.repeat(np.arange(len(words)), words)
            order = np.argsort(terms_at, kind="stable")
            ordered = terms_at[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
            columns = [
                starts.astype("<i4"),
                words.astype("<i4"),
                ordered[first].astype("<u8"),
                np.append(first, len(ordered)).astype("<i4"),
                place[order].astype("<i4"),
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays([0, len(words)], pa.concat_arrays(ids)),
                    *[pa.array([c.tobytes()], pa.binary()) for c in columns],
                ],
                names=["segment", "doc_ids", "doc_starts", "doc_words", "terms", "list_starts", "positions"],
            )

        held = 0
        for batch in slices(batches, "text", INDEX_BYTES):
            data, bounds = joined(batch.column(1).to_pylist())
            starts, _, found = hashed_words(LOWER[data], ALPHANUMERIC)
            ids.append(batch.column(0))
            counts.append(np.diff(np.searchsorted(starts, bounds)))
            hashes.append(found)
            held += len(found)
            if held >= SEGMENT_WORDS:
                yield segment()
                number, held = number + 1, 0
                ids, counts, hashes = [], [], []
        if ids:
            yield segment()

    chosen = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    return stage(chosen.mapInArrow(run, INDEX_SCHEMA.format(id=id_type)), "positional-index")


def indexed_documents(index: DataFrame) -> DataFrame:
    """(segment, ordinal, doc_id, n_words) of every document in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, ids, words in zip(*[batch.column(i) for i in range(3)]):
                counts = np.frombuffer(words.as_py(), "<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), segment.as_py()), pa.int64()),
                        pa.array(np.arange(len(counts)), pa.int64()),
                        ids.values,
                        pa.array(counts, pa.int64()),
                    ],
                    names=["segment", "ordinal", "doc_id", "n_words"],
                )

    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"segment long, ordinal long, doc_id {id_type}, n_words long"
    return index.select("segment", "doc_ids", "doc_words").mapInArrow(run, schema)


def _windows(words: np.ndarray, size: int) -> list[bytes]:
    if not len(words):
        return []
    size = min(size, len(words))
    return [words[i : i + size].astype("<u8").tobytes() for i in range(len(words) - size + 1)]


def phrases(items: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase binary, item_id): each item's windows of ``size`` words; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", INDEX_BYTES):
            data, bounds = joined(batch.column(1).to_pylist())
            starts, _, found = hashed_words(LOWER[data], ALPHANUMERIC)
            cuts = np.searchsorted(starts, bounds)
            each = [sorted(set(_windows(found[a:b], size))) for a, b in zip(cuts[:-1], cuts[1:])]
            rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for x in each for p in x], pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))],
                names=["phrase", "item_id"],
            )

    chosen = items.select(F.col(item_id).alias("item_id"), utf8(text).alias("text"))
    return chosen.mapInArrow(run, f"phrase binary, item_id {field_type(items, item_id)}")


class Postings:
    """The lists of one segment."""

    def __init__(self, terms: bytes, list_starts: bytes, positions: bytes):
        self.terms = np.frombuffer(terms, "<u8")
        self.starts = np.frombuffer(list_starts, "<i4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<i4").astype(np.int64)
        # (term, position) as one sorted number, so that a list is intersected by binary search
        self.keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) << 32) | self.positions

    def lookup(self, wanted: np.ndarray) -> np.ndarray:
        """Places of terms in the dictionary, -1 where a term does not occur."""
        if not len(self.terms):
            return np.full(wanted.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < 0, 0, self.starts[places + 1] - self.starts[places])

    def holds(self, places: np.ndarray, positions: np.ndarray) -> np.ndarray:
        key = (places << 32) | positions
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (positions >= 0)

    def exact(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, start position) of every occurrence of phrases of equal length, one per row."""
        places = self.lookup(queries)
        alive = np.flatnonzero((places >= 0).all(axis=1))
        places = places[alive]
        sizes = self.sizes(places)
        rarest = np.argsort(sizes, axis=1, kind="stable")
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.arange(len(alive))
        offset = rarest[:, 0]
        length = sizes[rows, offset]
        query = np.repeat(rows, length)
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        begin = self.positions[np.repeat(self.starts[places[rows, offset]], length) + within] - offset[query]
        for step in range(1, queries.shape[1]):
            offset = rarest[query, step]
            kept = self.holds(places[query, offset], begin + offset)
            query, begin = query[kept], begin[kept]
        return alive[query], begin

    def near(self, terms: np.ndarray, within: int, doc_starts: np.ndarray) -> np.ndarray:
        """Positions of the first of ``terms`` with every other at most ``within`` words away in its document.

        The rarest term's list says where to look; the others are taken rarest first.
        """
        places = self.lookup(terms)
        if (places < 0).any():
            return np.zeros(0, np.int64)
        lists = [self.positions[self.starts[p] : self.starts[p + 1]] for p in places]
        others = sorted(lists[1:], key=len)
        at = lists[0]
        if others and len(others[0]) < len(at):
            low = np.searchsorted(at, others[0] - within)
            size = np.searchsorted(at, others[0] + within, side="right") - low
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at = np.unique(at[np.repeat(low, size) + step])
        doc = np.searchsorted(doc_starts, at, side="right")
        for other in others:
            left = other[np.maximum(np.searchsorted(other, at, side="right") - 1, 0)]
            right = other[np.minimum(np.searchsorted(other, at), len(other) - 1)]
            close = np.zeros(len(at), bool)
            for found in (left, right):
                close |= (np.abs(found - at) <= within) & (np.searchsorted(doc_starts, found, side="right") == doc)
            at, doc = at[close], doc[close]
        return at


def _in_blocks(wanted: DataFrame, column: str) -> Iterator[list]:
    """Distinct values of ``column`` in lists of about ``PHRASES_PER_BLOCK``, one after the other."""
    distinct = stage(wanted.select(column).distinct(), "query-phrases")
    blocks = max(1, math.ceil(distinct.count() / PHRASES_PER_BLOCK))
    for block in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64(column), F.lit(blocks)) == block)
        yield [row[0] for row in part.toLocalIterator()]


def find_phrases(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(segment, ordinal, phrase, starts array<int>): where each phrase of ``wanted`` occurs in each document.

    The phrases go out in blocks of bounded size; every block meets every segment.
    """
    out: DataFrame | None = None
    schema = "segment long, ordinal long, phrase binary, starts array<int>"
    for block in _in_blocks(wanted, "phrase"):
        by_length: dict[int, list[bytes]] = {}
        for phrase in block:
            by_length.setdefault(len(phrase) // 8, []).append(phrase)
        shipped = index.sparkSession.sparkContext.broadcast(by_length)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            tables = {n: np.frombuffer(b"".join(p), "<u8").reshape(-1, n) for n, p in shipped.value.items()}
            for batch in batches:
                for segment, doc_starts, *lists in zip(*[batch.column(i) for i in range(5)]):
                    postings = Postings(*[x.as_py() for x in lists])
                    firsts = np.frombuffer(doc_starts.as_py(), "<i4")
                    for n, queries in tables.items():
                        query, begin = postings.exact(queries)
                        ordinal = np.searchsorted(firsts, begin, side="right") - 1
                        order = np.lexsort((begin, query, ordinal))
                        query, begin, ordinal = query[order], begin[order], ordinal[order]
                        new = np.flatnonzero(
                            np.concatenate([[True], (query[1:] != query[:-1]) | (ordinal[1:] != ordinal[:-1])])
                        ) if len(query) else np.zeros(0, np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(new), segment.as_py()), pa.int64()),
                                pa.array(ordinal[new], pa.int64()),
                                pa.array([shipped.value[n][q] for q in query[new]], pa.binary()),
                                pa.ListArray.from_arrays(
                                    pa.array(np.append(new, len(query)), pa.int32()),
                                    pa.array(begin - firsts[ordinal], pa.int32()),
                                ),
                            ],
                            names=["segment", "ordinal", "phrase", "starts"],
                        )

        columns = index.select("segment", "doc_starts", "terms", "list_starts", "positions")
        found = columns.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def find_near(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, position): where the first of ``terms`` stands with all others at most ``within`` words away."""
    wanted = np.concatenate([hashed_words(LOWER[np.frombuffer(t.encode(), np.uint8)], ALPHANUMERIC)[2] for t in terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, doc_starts, *lists in zip(*[batch.column(i) for i in range(5)]):
                firsts = np.frombuffer(doc_starts.as_py(), "<i4")
                at = Postings(*[x.as_py() for x in lists]).near(wanted, within, firsts)
                ordinal = np.searchsorted(firsts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(ordinal, pa.int64())), pa.array(at - firsts[ordinal], pa.int64())],
                    names=["doc_id", "position"],
                )

    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    columns = index.select("doc_ids", "doc_starts", "terms", "list_starts", "positions")
    return columns.mapInArrow(run, f"doc_id {id_type}, position long")


def _covered(starts: Column, size: Column) -> Column:
    """Words under windows of ``size`` words that begin at sorted distinct ``starts``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, begin: Column) -> Column:
        stop = begin.getField("at") + begin.getField("size")
        fresh = F.greatest(stop - F.greatest(acc["end"], begin.getField("at")), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], stop).alias("end"))

    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


#: words as they are cut from lower-cased texts, with the capitals that are lowered
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def longer_items(items: DataFrame, least: int, text: str = "text") -> DataFrame:
    """The items of at least ``least`` words.  NULL has none."""
    return items.where(F.regexp_count(text, F.lit(WORD)) >= least)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>): document words under occurrences of item windows.

    A window is ``size`` consecutive item words, or a whole shorter item.  Texts are lower-cased
    (A-Z) and cut into words of ASCII letters, digits and non-ASCII characters.  Every document
    row comes back, also with NULL or empty text (no words) and repeated ids; items without
    words or without id give hits without a name.  Other columns are not read.
    """
    index = build_index(docs, doc_id, text)
    wanted = stage(phrases(items, size, item_id, text), "benchmark-phrases")
    hits = stage(find_phrases(index, wanted), "phrase-hits")
    place = ["segment", "ordinal"]
    begins = hits.select(*place, F.explode("starts").alias("at"), (F.length("phrase") / 8).cast("int").alias("size"))
    # one entry per start: the longest window that begins there
    longest = begins.groupBy(*place, "at").agg(F.max("size").alias("size"))
    covered = longest.groupBy(*place).agg(
        _covered(F.array_sort(F.collect_list(F.struct("at", "size"))), F.lit(size)).alias("n_hit")
    )
    named = (
        hits.select(*place, "phrase")
        .join(wanted.where(F.col("item_id").isNotNull()), "phrase")
        .groupBy(*place)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    every = indexed_documents(index)
    return (
        every.join(covered, place, "left")
        .join(named, place, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
