"""SimHash near-duplicates through covering locality-sensitive hashing.

Every fingerprint bit gets a non-zero vector of ``radius + 1`` bits.  For each non-zero
vector v there is one table, whose mask keeps the bits with an odd product with v.  The
vectors of at most ``radius`` differing bits span less than the whole space, so some v is
orthogonal to all of them and that table's mask hides every difference: each pair within
the radius collides in at least one table, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import field_type, slices, stage, utf8
from paperloom.llm.components import components

BITS = 64
SEED = 42
BLOCK = 1 << 16
BUCKET_LIMIT = 4096


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned.  No words: 0; fewer than a shingle: the whole sequence is one."""
    import xxhash

    words = data.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    text = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, count, BLOCK):
        b = min(a + BLOCK, count)
        hashes = [digest(text[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + size - 1 : b + size - 1].tolist())]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): the SimHash of every whole text, as a signed long.  NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {field_type(docs, doc_id)}, fp long")


def covering_masks(radius: int) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks over the fingerprint bits."""
    top = 2 ** (radius + 1) - 1
    vectors = [bit % top + 1 for bit in range(BITS)]
    return [sum(1 << bit for bit, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, top + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _near(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is connected within one bucket: a visited value leaves the search."""
    rest = np.sort(values.view(np.uint64))  # bits are counted in unsigned values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue:
            at = queue.pop()
            close = np.bitwise_count(rest ^ at) <= radius
            if close.any():
                found, rest = rest[close], rest[~close]
                yield from ((int(a), int(at.view(np.int64))) for a in found.view(np.int64))
                queue.extend(found)


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join exactly what pairs within ``radius`` join.

    A bucket of two is compared in place.  Larger ones are read by one task each, up to
    ``BUCKET_LIMIT`` values; beyond that a bucket is cut again: its undecided bits are dealt to
    ``radius + 1`` parts and two values within the radius agree on one part at least.  Each cut
    fixes some of the bits, so it ends.  No pair list is built: a bucket gives fewer links
    than it has values.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(~m & (2**64 - 1))).alias("free")) for m in masks])
    keyed = distinct.select("fp", F.explode(tables).alias("t")).select(
        "fp",
        F.col("t.free").alias("free"),
        F.xxhash64("t.mask", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("key"),
    )
    links: DataFrame | None = None
    while True:
        sizes = keyed.groupBy("key", "free").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        sizes = stage(sizes.where("n > 1"), "buckets")
        twos = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= radius))
        found = twos.select(F.col("low").alias("a"), F.col("high").alias("b"))
        links = found if links is None else links.unionByName(found)
        middle = sizes.where((F.col("n") > 2) & (F.col("n") <= BUCKET_LIMIT)).select("key", "free")
        groups = keyed.join(middle, ["key", "free"]).groupBy("key", "free").agg(F.collect_list("fp").alias("fps"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [p for fps in batch.column(0) for p in _near(fps.values.to_numpy(), radius)]
                frame = pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

        links = links.unionByName(groups.select("fps").mapInArrow(run, "a long, b long"))
        large = sizes.where(F.col("n") > BUCKET_LIMIT).select("key", "free")
        if large.isEmpty():
            return links
        bits = "filter(sequence(0, 63), b -> (shiftrightunsigned(free, b) & 1L) = 1L)"
        dealt = f"aggregate(filter({bits}, (b, i) -> i % {radius + 1} = j), 0L, (part, b) -> part | shiftleft(1L, b))"
        parts = F.expr(f"transform(sequence(0, {radius}), j -> {dealt})")
        keyed = stage(
            keyed.join(large, ["key", "free"])
            .select("fp", "key", "free", F.explode(parts).alias("part"))
            .select(
                "fp",
                F.col("free").bitwiseAND(F.bitwise_not("part")).alias("free"),
                F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("part"))).alias("key"),
            ),
            "cut-buckets",
        )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id): groups of texts linked by at most ``radius`` differing bits.

    ``component_id`` is the least id of the group.  Texts without words have fingerprint 0 and
    link like any other; equal texts share a fingerprint and meet as one value, however many
    there are.  Repeated rows give repeated rows.  A NULL id never names a group unless the group
    has no other.  An empty table gives no rows; other columns of the input are not read.
    """
    prints = stage(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    return with_components(prints, radius)


def with_components(prints: DataFrame, radius: int) -> DataFrame:
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), radius))
    known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least_id"
    )
    # a fingerprint without links is its own group; only linked ones are grouped
    grouped = stage(known, "rooted")
    names = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stage(grouped.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
