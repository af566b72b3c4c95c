"""Homomorphic fingerprints of documents: sums of wide vectors hashed from their paragraphs.

A paragraph (a line of the text) gives two vectors of ``LANES`` numbers, and a document's
state is the sum over its paragraphs, modulo 2**16 in every lane of the proof and in 64 bits
in every lane of the sketch, which is read as a number and must not wrap:

* ``proof``: uniform numbers drawn from the paragraph's SHAKE-128 stream.  Two documents have
  the same sum only if they hold the same paragraphs equally often, in any order.
* ``sketch``: every pair of neighbouring words adds +1 or -1 to one lane, chosen by its hash.
  The scalar product of two such sums estimates how many pairs they share, with an error of
  about one part in the square root of ``LANES``.

Sums can be extended and shortened: adding or subtracting a paragraph's vectors inserts or
deletes it.  The printed fingerprint is the SHA-256 of both sums, of the sketch's modulo 2**16.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import field_type, slices, stage
from paperloom.llm.words import NOT_SPACE, hashed_words, joined, mixed

LANES = 1024
SLICE_BYTES = 1 << 20
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


class State:
    """Both sums of one document, or of any set of paragraphs."""

    def __init__(self, proof: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.proof = np.zeros(LANES, np.uint16) if proof is None else proof
        self.sketch = np.zeros(LANES, np.int64) if sketch is None else sketch

    def __add__(self, other: State) -> State:
        return State(self.proof + other.proof, self.sketch + other.sketch)

    def __sub__(self, other: State) -> State:
        return State(self.proof - other.proof, self.sketch - other.sketch)

    def digest(self) -> str:
        return hashlib.sha256(self.proof.astype("<u2").tobytes() + self.sketch.astype("<i2").tobytes()).hexdigest()

    def likeness(self, other: State) -> float:
        """1 for equal paragraphs, else the estimated share of word pairs in common, 0 to 1."""
        if np.array_equal(self.proof, other.proof):
            return 1.0
        a, b = self.sketch.astype(np.float64), other.sketch.astype(np.float64)
        size = a @ a + b @ b
        return float(min(max(2.0 * (a @ b) / size, 0.0), 1.0)) if size else 0.0


def _proof(paragraphs: Iterable[bytes]) -> np.ndarray:
    drawn = b"".join([hashlib.shake_128(p).digest(2 * LANES) for p in paragraphs])
    return np.frombuffer(drawn, "<u2").reshape(-1, LANES).sum(axis=0, dtype=np.uint16)


def states(texts: list[bytes]) -> list[State]:
    """The states of texts; an empty text holds no paragraph."""
    data, bounds = joined(texts)
    starts, _, words = hashed_words(data, NOT_SPACE)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    follows = np.zeros(len(words), bool)
    follows[:-1] = line[1:] == line[:-1]
    led = np.zeros(len(words), bool)
    led[1:] = follows[:-1]
    after = np.zeros(len(words), np.uint64)
    after[:-1] = words[1:]
    # pairs of neighbours in a paragraph; a paragraph's only word stands for itself
    used = follows | ~led
    hashes = mixed(words * PAIR + np.where(follows, after, np.uint64(0)))[used]
    lane = (hashes >> np.uint64(32)).astype(np.int64) % LANES
    sign = np.where(hashes & np.uint64(1), 1.0, -1.0)
    cuts = np.concatenate([[0], np.cumsum(used)])[np.searchsorted(starts, bounds)]
    out = []
    for text, a, b in zip(texts, cuts[:-1], cuts[1:]):
        sketch = np.bincount(lane[a:b], sign[a:b], LANES).astype(np.int64)
        out.append(State(_proof(text.split(b"\n")) if text else None, sketch))
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, proof, sketch): the digest of every whole text and its sums, as 16-bit and 64-bit lanes.

    NULL counts as empty.  Equal texts have equal rows; the order of paragraphs does not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = states([t.encode() if t else b"" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s.digest() for s in found]),
                    pa.array([s.proof.astype("<u2").tobytes() for s in found], pa.binary()),
                    pa.array([s.sketch.astype("<i8").tobytes() for s in found], pa.binary()),
                ],
                names=["doc_id", "fingerprint", "proof", "sketch"],
            )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {field_type(docs, doc_id)}, fingerprint string, proof binary, sketch binary")


REPORT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def spliced(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by as much of the start of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _report(texts: list[str], following: list[str]) -> dict[str, list]:
    edited = [spliced(a, b).encode() for a, b in zip(texts, following)]
    n = len(texts)
    found = states([*[t.encode() for t in texts], *edited, *[t.encode() for t in following[-1:]]])
    own, changed = found[:n], found[n : 2 * n]
    after = [*own[1:], found[-1]] if n else []
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": [s.digest() for s in own],
        "edited_fingerprint": [s.digest() for s in changed],
        "near_edited": [a.likeness(b) for a, b in zip(own, changed)],
        "near_next": [a.likeness(b) for a, b in zip(own, after)],
    }


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Each document's edited text is its own with the last half replaced by the start of the
    next document by ascending id; the last is followed by the first.  Documents are
    range-partitioned once by id; each partition reports all its rows but the last, which
    meets the next partition's first through boundary records, one of each per partition.

    NULL text counts as empty, NULL ids come first, rows with the same id follow by content;
    a single document follows itself; an empty table gives no rows.
    """
    kind = field_type(docs, doc_id)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", "tie", "text"]
    ordered = chosen.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions(*order)
    names = ["doc_id", *[c.split(" ")[0] for c in REPORT.split(", ")]]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(ids: pa.Array, found: dict, part: int | None, first: str | None, last: str | None) -> pa.RecordBatch:
        n = len(ids)
        edge = part is not None
        columns = [ids, *[pa.array(found[c] if found else [None] * n, t) for c, t in zip(names[1:], types)]]
        columns += [pa.array([part if edge else None] * n, pa.int32()), pa.array([first] * n, pa.string()), pa.array([last] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "part", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        held: tuple[pa.Array, str] | None = None
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            first = texts[0] if first is None else first
            if held:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            if len(texts) > 1:
                yield rows(ids[:-1], _report(texts[:-1], texts[1:]), None, None, None)
            held = ids[-1:], texts[-1]
        if held:
            yield rows(held[0], {}, TaskContext.get().partitionId(), first, held[1])

    schema = f"doc_id {kind}, {REPORT}, part int, first string, last string"
    found = stage(ordered.select("doc_id", "text").mapInArrow(run, schema), "edit-reports")
    parts = Window.orderBy("part")
    everything = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = found.where("part is not null").select(
        "doc_id", "last", F.coalesce(F.lead("first").over(parts), F.first("first").over(everything)).alias("next")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                report = _report([batch.column(1)[i].as_py()], [batch.column(2)[i].as_py()])
                yield rows(batch.column(0)[i : i + 1], report, None, None, None).select(names)

    across = edges.mapInArrow(meet, f"doc_id {kind}, {REPORT}")
    return found.where("part is null").select(*names).unionByName(across)
