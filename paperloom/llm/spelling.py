"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes.

Two words are one edit apart exactly if their common prefix and suffix together reach the length
of the longer word minus one and their lengths differ by one at most.  Padded matrices of code
points give both lengths for every pair of a tile at once.

Words meet in buckets (m, lo, hi): pairs whose longer word has m letters and whose common prefix
is ``lo`` to ``hi - 1`` long.  Such words share their first ``lo`` and last ``m - hi`` letters, which
name the bucket.  A bucket that is too large for a tile is cut at the middle of its range; each pair
then lies in exactly one of the halves.  A range of one leaves a single free letter, so a bucket
that cannot be cut holds at most one word per letter and one shorter word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices, stage, utf8
from paperloom.llm.words import LOWER

#: all code points of a word are below 256, so a word is as many bytes in this charset
CHARSET = "ISO-8859-1"
WORD = re.compile("[a-zÀ-ÿ]+")
PIECE = 1 << 20
HELD = 100_000
TILE_WORDS, TILE_LETTERS = 512, 1 << 20
CELLS = 1 << 21
#: rows of a stack of tiles; a bucket takes the next larger size
HEIGHTS = np.array(sorted({*range(2, 9), *[a << b for a in (4, 5, 6, 7) for b in range(1, 20)]}))

BUCKET = ["m", "lo", "hi", "key"]


def typed_words(text: str, name: str) -> Iterator[tuple[str, int]]:
    """(word, times) of a lower-cased text, in pieces, each run with its planted deletion."""
    start = 0
    while start < len(text):
        end = start + PIECE
        run = WORD.match(text, end)
        end = run.end() if run else end
        for word, times in Counter(WORD.findall(text, start, end)).items():
            h = zlib.crc32(f"{name}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            yield word, times
        start = end


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 5, least: int = 3) -> DataFrame:
    """(word binary, n) of the words of all texts; counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array([w.encode("latin-1") for w in held], pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered = text.as_py().translate(LOWER.tobytes()).decode(errors="replace")
                for word, times in typed_words(lowered, name):
                    if len(word) >= least_letters:
                        held[word] += times
                if len(held) >= HELD:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    named = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), utf8(text).alias("text"))
    counts = named.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


def _buckets(rows: DataFrame, ranges: Column) -> DataFrame:
    """``rows`` (word, n, m) once per range (lo, hi), each with the hash of what its bucket shares."""
    cut = rows.withColumn("r", F.explode(ranges)).select("word", "n", "m", "r.*")
    letters = F.length("word")
    shared = F.xxhash64(
        F.substring("word", F.lit(1), F.col("lo")), F.substring("word", letters - F.col("m") + F.col("hi") + 1, F.col("m") - F.col("hi"))
    )
    return cut.select("word", "n", "m", "lo", "hi", shared.alias("key"))


def _halves(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


def tiled(words: DataFrame, tile_words: int = TILE_WORDS, tile_letters: int = TILE_LETTERS) -> DataFrame:
    """(m, lo, hi, words) of buckets that fit a tile; ``words`` are (rank, word, n), most frequent first."""
    longer = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    todo, ready = _buckets(longer, _halves(F.lit(0), F.col("m"))), None
    while True:
        todo = stage(todo, "buckets")
        sizes = todo.groupBy(*BUCKET).agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("letters"))
        large = ((F.col("rows") > tile_words) | (F.col("letters") > tile_letters)) & (F.col("rows") > 1) & (F.col("hi") - F.col("lo") > 1)
        hot = stage(sizes.where(large).select(*BUCKET), "hot-buckets")
        if hot.isEmpty():
            ready = todo if ready is None else ready.unionByName(todo)
            break
        fits = todo.join(hot.hint("merge"), BUCKET, "left_anti")
        ready = fits if ready is None else ready.unionByName(fits)
        split = todo.join(hot.hint("merge"), BUCKET, "left_semi").select("word", "n", "m", "lo", "hi")
        split = split.withColumn("halves", _halves(F.col("lo"), F.col("hi"))).drop("lo", "hi")
        todo = _buckets(split, F.col("halves"))
    # a bucket fits a tile or has one free letter, so what a task gathers is bounded
    entry = F.struct(F.negative("n").alias("rank"), "word")
    grouped = ready.groupBy(*BUCKET).agg(F.array_sort(F.collect_list(entry)).alias("words"))
    return grouped.where(F.size("words") > 1).select("m", "lo", "hi", "words")


def _padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, right: bool) -> np.ndarray:
    """Words as rows of code points, at the left or right edge of ``width`` columns, 0 beside them."""
    columns = np.arange(width)
    place = columns - (width - lengths[..., None]) if right else np.broadcast_to(columns, (*lengths.shape, width))
    inside = (place >= 0) & (place < lengths[..., None])
    return np.where(inside, data[np.where(inside, starts[..., None] + place, 0)], 0).astype(np.uint8)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of stacks ``a`` and ``b``: how many leading columns agree, for every pair of a stack."""
    differs = a[:, :, None, :] != b[:, None, :, :]
    return np.where(differs.any(axis=3), differs.argmax(axis=3), a.shape[2])


def near_in_tiles(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Near words within stacked tiles: (how many, the first one's row or -1), for every row of every tile.

    ``starts`` and ``lengths`` are tiles x rows; an empty row has length 0.  Tiles are compared in blocks of rows.
    """
    tiles, rows = lengths.shape
    width = int(m.max())
    left, right = (_padded(data, starts, lengths, width, side) for side in (False, True))
    right = right[:, :, ::-1]
    n_near, first = np.zeros((tiles, rows), np.int64), np.full((tiles, rows), -1)
    step = max(1, CELLS // (tiles * rows * width))
    box = lambda v: v[:, None, None]
    for at in range(0, rows, step):
        part = slice(at, at + step)
        a, b = lengths[:, part, None], lengths[:, None, :]
        least, most = np.minimum(a, b), np.maximum(a, b)
        prefix = np.minimum(_agreeing(left[:, part], left), least)
        suffix = np.minimum(_agreeing(right[:, part], right), least)
        near = (least > 0) & (most == box(m)) & (most - least <= 1) & (prefix + suffix >= most - 1)
        near &= (prefix >= box(lo)) & (prefix < box(hi))
        n_near[:, part] = near.sum(axis=2)
        first[:, part] = np.where(near.any(axis=2), near.argmax(axis=2), -1)
    return n_near, first


def near_counts(words: DataFrame, tile_words: int = TILE_WORDS, tile_letters: int = TILE_LETTERS) -> DataFrame:
    """(word, n_near, best): per word of ``words`` (word, n) that has near words, their number and the best (rank, word).

    Every near pair lies in one tile, so numbers add up; no list of pairs is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            inner = lists.values
            ranks, words = inner.field(0), inner.field(1)
            starts = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
            data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(1, np.uint8)
            lengths, sizes = np.diff(starts), np.diff(bounds)
            height = HEIGHTS[np.searchsorted(HEIGHTS, sizes)]
            order = np.lexsort((m, height))
            ordered = height[order]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            at = 0
            while at < len(order):
                h = ordered[at]
                end, same = at + 1, int(np.searchsorted(ordered, h, side="right"))
                while end < same and (end + 1 - at) * h * h * m[order[end]] <= CELLS:
                    end += 1
                tiles = order[at:end]
                row = bounds[tiles][:, None] + np.arange(h)
                used = np.arange(h) < sizes[tiles][:, None]
                row = np.where(used, row, 0)
                n_near, first = near_in_tiles(data, starts[row], np.where(used, lengths[row], 0), m[tiles], lo[tiles], hi[tiles])
                hit = n_near > 0
                best = np.take_along_axis(row, np.maximum(first, 0), axis=1)
                found.append((row[hit], n_near[hit], best[hit]))
                at = end
            if found:
                word, n_near, best = (np.concatenate(c) for c in zip(*found))
                best_struct = pa.StructArray.from_arrays([ranks.take(pa.array(best)), words.take(pa.array(best))], names=["rank", "word"])
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(word)), pa.array(n_near), best_struct], names=["word", "n_near", "best"]
                )

    found = tiled(words, tile_words, tile_letters).mapInArrow(run, "word binary, n_near long, best struct<rank:long,word:binary>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms followed to their end.  Every form is more frequent, so there is no cycle."""
    reached = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not reached.where("moved").isEmpty():
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        moved = reached.join(ahead.hint("merge"), "root", "left")
        reached = stage(
            moved.select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("moved")), "forms"
        )
    return reached.select("word", "root")


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 5, least: int = 3, times: int = 2, **tile: int
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least_letters`` letters and ``least`` occurrences.

    Words are runs of Latin letters, A-Z lower-cased, one letter dropped where the hash of id and run says so.
    ``form`` is the near word (one letter inserted, deleted or replaced) of largest n, ties the smallest, if it
    occurs ``times`` as often; ``root`` ends the chain of forms.  NULL and empty texts hold no words, a NULL id
    counts as empty, repeated rows count each time, other columns are ignored; an empty table gives no rows.
    """
    words = stage(count_words(docs, doc_id, text, least_letters, least), "words")
    near = near_counts(words, **tile)
    form_n = F.negative("best.rank")
    often = form_n >= times * F.col("n")
    rows = words.join(near.hint("merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.word")).alias("form"),
        F.when(often, form_n).alias("form_n"),
    )
    rows = stage(rows, "near-words")
    roots = last_forms(rows.where("form is not null").select("word", "form"))
    done = rows.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
    spelled = [F.decode(c, CHARSET).alias(c) for c in ("word", "form", "root")]
    return done.select(*spelled, "n", "n_near", "form_n")
