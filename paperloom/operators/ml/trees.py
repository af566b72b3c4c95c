"""Boosted trees and forests from histograms, a whole grid at once.

Features are binned once into a written table of bytes.  A level of all trees that grow side by side (every
fold, every depth and rate, every class) is one pass over that table: each task adds gradients up by
node and bin, the sums meet, and the driver picks the best cut of every node from them.  No rows are shuffled.

Boosting: rounds build on each other, so the model of 50 rounds is the start of the one of 200, and the grid needs
one fit per depth and rate.  Forests: trees are independent and a node does not look at what lies below it, so 100
trees are the first of 200 and a tree of depth 10 is the top of a deeper one; the grid needs one forest.  A forest's node
of at most ``LOCAL_ROWS`` rows is finished by one task, as its rows fit there.

Sums are of multiples of a power of two and exact, so results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import base64
import io
import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.materialize import discard, ensure_checkpointing, materialize
from paperloom.plans.project import spread

BINS = 64
CHUNK_ROWS = 1 << 15
LOCAL_ROWS = 1 << 15
#: cells of a histogram that one pass returns, and of what a task holds to add it up
PASS_CELLS, TASK_CELLS = 1 << 23, 1 << 22
DRAWN_ROWS = 1 << 22  # rows whose draws a task adds up by place at once
CHECKPOINT_ROUNDS = 20
COLLECTED_PARTS = 16

# --- fixed values: must equal the expected output ---------------------------------
LAMBDA, LEAST_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-6
# -----------------------------------------------------------------------------------


@dataclass
class Bins:
    """Cut points per feature; a value's bin is the number of cuts below it.  ``offsets`` lay all bins side by side."""

    cuts: list[np.ndarray]

    def __post_init__(self) -> None:
        sizes = [len(c) + 1 for c in self.cuts]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.total = int(self.offsets[-1])
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        self.last = np.zeros(self.total, bool)
        self.last[self.offsets[1:] - 1] = True

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, values[:, i]) for i, c in enumerate(self.cuts)]).astype(np.uint8)


def fit_bins(rows: DataFrame, bins: int = BINS) -> Bins:
    """Cuts at quantiles of each feature (a mergeable sketch), and one above the least value."""
    values = rows.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    shares = [i / bins for i in range(1, bins)]
    found = values.groupBy("feature").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.percentile_approx("value", shares, 10 * bins).alias("cuts")
    )
    return Bins([np.array([c for c in sorted({r.low, *r.cuts}) if c < r.high]) for r in found.orderBy("feature").collect()])


@dataclass
class Chunk:
    """Rows of one piece of the byte table; ``scores`` is models x rows while boosting."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    row: np.ndarray
    scores: np.ndarray | None = None


def binned(rows: DataFrame, bins: Bins) -> tuple[RDD, DataFrame]:
    """``rows`` (features, label, fold, row) as chunks of bytes, written once and read by every pass, and the written table."""
    width = len(bins.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK_ROWS):
                features, label, fold, row = batch.slice(at, CHUNK_ROWS).columns
                values = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                parts = [bins.of(values), *[c.to_numpy(zero_copy_only=False).astype(t) for c, t in ((label, "f8"), (fold, "i2"), (row, "i8"))]]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=names)

    names = ["bins", "label", "fold", "row"]
    given = spread(rows).select(vector_to_array("features").alias("features"), "label", "fold", "row")
    table = materialize(given.mapInArrow(run, ", ".join(f"{n} binary" for n in names)), "bins")

    def read(r) -> Chunk:
        label = np.frombuffer(r.label, "f8")
        return Chunk(np.frombuffer(r.bins, np.uint8).reshape(len(label), width), label, np.frombuffer(r.fold, "i2"), np.frombuffer(r.row, "i8"))

    # what memory does not hold is read from the table again, as it is on disk already
    return table.rdd.map(read).persist(StorageLevel.MEMORY_ONLY), table


@dataclass
class Trees:
    """Trees that grow side by side.  Nodes of all trees lie in one array; tree t starts at ``roots[t]``."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    path: np.ndarray

    @staticmethod
    def stumps(trees: int, channels: int, seeds: np.ndarray | None = None) -> Trees:
        path = np.zeros(trees, np.uint64) if seeds is None else seeds.astype(np.uint64)
        none = np.full(trees, -1, np.int32)
        return Trees(np.arange(trees), none, np.zeros(trees, np.uint8), none, np.zeros((trees, channels)), path)

    def route(self, bins: np.ndarray, node: np.ndarray, steps: int = 1 << 30) -> np.ndarray:
        """Where rows (columns of ``node``: trees x rows) are after at most ``steps`` steps further down."""
        columns, at = bins.T, np.arange(len(bins))
        for _ in range(steps):
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                break
            right = columns[np.maximum(feature, 0), at] > self.cut[node]
            node = np.where(inner, self.left[node] + right, node)
        return node

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Give ``nodes`` two children each, with ``values`` (nodes x 2 x channels); returns the children."""
        start = len(self.feature)
        children = start + np.arange(2 * len(nodes))
        grown = 2 * len(nodes)
        feature_of, cut_of, left_of = self.feature.copy(), self.cut.copy(), self.left.copy()
        feature_of[nodes], cut_of[nodes], left_of[nodes] = feature, cut, children[::2]
        none = np.full(grown, -1, np.int32)
        self.feature = np.concatenate([feature_of, none])
        self.cut = np.concatenate([cut_of, np.zeros(grown, np.uint8)])
        self.left = np.concatenate([left_of, none])
        self.value = np.concatenate([self.value, values.reshape(grown, self.value.shape[1])])
        sides = self.path[nodes][:, None] * np.uint64(2) + np.array([1, 2], np.uint64)
        self.path = np.concatenate([self.path, sides.ravel()])
        return children


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Rule:
    """How nodes are cut: penalty, least weight of a child, least gain, and how many random features a node looks at (0: all)."""

    penalty: float
    least_weight: float
    least_gain: float
    features: int = 0


def _looked_at(usable: np.ndarray, rule: Rule, path: np.ndarray) -> np.ndarray:
    """Which features (nodes x features) a node looks at: the first ones that can be cut, in a random order per node."""
    order = mixed(mixed(path)[:, None] + np.arange(1, usable.shape[1] + 1, dtype=np.uint64))
    return np.where(usable, order, np.uint64(2**64 - 1)).argsort(1).argsort(1) < rule.features


def best_cuts(sums: np.ndarray, bins: Bins, rule: Rule, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, cut, sums of both sides) per node of ``sums`` (nodes x bins x channels, weight last)."""
    running = sums.cumsum(axis=1)
    before = np.concatenate([np.zeros_like(running[:, :1]), running], axis=1)
    left = running - before[:, bins.offsets[bins.feature]]
    whole = before[:, bins.offsets[1]]
    right = whole[:, None] - left

    def worth(s: np.ndarray) -> np.ndarray:
        weight = s[..., -1] + rule.penalty
        return np.divide((s[..., :-1] ** 2).sum(-1), weight, out=np.zeros_like(weight), where=weight > 0)

    gain = worth(left) + worth(right) - worth(whole)[:, None]
    fits = ~bins.last & (left[..., -1] >= rule.least_weight) & (right[..., -1] >= rule.least_weight) & (gain > rule.least_gain)
    if rule.features:
        usable = np.logical_or.reduceat(fits, bins.offsets[:-1], axis=1)
        fits &= _looked_at(usable, rule, path)[:, bins.feature]
    gain = np.where(fits, gain, -np.inf)
    best, rows = gain.argmax(1), np.arange(len(gain))
    feature = bins.feature[best]
    return gain[rows, best], feature, (best - bins.offsets[feature]).astype(np.uint8), np.stack([left[rows, best], right[rows, best]], 1)


def add_up(bins: Bins, data: np.ndarray, slot: np.ndarray, weights: Sequence[np.ndarray], slots: int) -> np.ndarray:
    """Sums (slots x bins x channels) of ``weights`` (trees x rows each) by slot (trees x rows, -1: none) and bin."""
    # one slot more takes the rows that are in none
    out = np.zeros((len(weights), (slots + 1) * bins.total))
    step = max(1, TASK_CELLS // max(1, slot.shape[0]))
    for at in range(0, len(data), step):
        part = slice(at, at + step)
        start = np.where(slot[:, part] >= 0, slot[:, part], slots) * bins.total
        given = [np.ascontiguousarray(w[:, part]).ravel() for w in weights]
        for feature, offset in enumerate(bins.offsets[:-1]):
            keys = (start + (data[part, feature] + offset)).ravel()
            for channel, w in enumerate(given):
                out[channel] += np.bincount(keys, w, minlength=out.shape[1])
    out = out[:, : slots * bins.total]
    return np.moveaxis(out.reshape(len(weights), slots, bins.total), 0, 2)


def summed(parts: RDD) -> np.ndarray:
    """The sum of one array per partition, in a tree where there are many."""
    if parts.getNumPartitions() <= COLLECTED_PARTS:
        return sum(parts.collect())
    return parts.treeReduce(lambda a, b: a + b, depth=3)


# places: rows of equal bins --------------------------------------------------------------
@dataclass
class Places:
    """The different rows of bins.  Trees cannot tell rows of a place apart, so sums by place stand for its rows."""

    keys: np.ndarray
    bins: np.ndarray

    @staticmethod
    def radix(bins: Bins) -> np.ndarray:
        return np.cumprod([1, *np.diff(bins.offsets)[:-1]], dtype=np.int64)

    @staticmethod
    def found(chunks: RDD, bins: Bins, most: int) -> Places | None:
        """The places of a table; none beyond ``most``."""
        sizes = np.diff(bins.offsets)
        if not len(sizes) or not most or math.prod(sizes.tolist()) >= 1 << 62:
            return None
        radix = Places.radix(bins)

        def both(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
            if a is None or b is None:
                return None
            union = np.union1d(a, b)
            return union if len(union) <= most else None

        keys = chunks.map(lambda c: np.unique(c.bins.astype(np.int64) @ radix)).treeReduce(both, depth=3)
        if keys is None or len(keys) > most:
            return None
        return Places(keys, (keys[:, None] // radix % sizes).astype(np.uint8))

    def of(self, bins: Bins, data: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, data.astype(np.int64) @ Places.radix(bins))


Weights = Callable[[Chunk], list[np.ndarray]]


def level_sums(chunks: RDD, bins: Bins, trees: Trees, nodes: np.ndarray, weights: Weights, channels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, sums) of ``nodes`` by passes over all chunks, as many nodes to a pass as its result may hold."""
    step = max(1, PASS_CELLS // (bins.total * channels))
    for at in range(0, len(nodes), step):
        part = nodes[at : at + step]
        slots = np.full(len(trees.feature), -1, np.int64)
        slots[part] = np.arange(len(part))

        def run(held: Iterator[Chunk], slots=slots, size=len(part)) -> Iterator[np.ndarray]:
            total = np.zeros((size, bins.total, channels))
            for c in held:
                w = weights(c)
                start = np.repeat(trees.roots[:, None], len(c.label), axis=1)
                slot = np.where(w[-1] > 0, slots[trees.route(c.bins, start)], -1)
                total += add_up(bins, c.bins, slot, w, size)
            yield total

        yield part, summed(chunks.mapPartitions(run))


def _values(sums: np.ndarray, rule: Rule) -> np.ndarray:
    weight = sums[..., -1:] + rule.penalty
    return np.divide(sums[..., :-1], weight, out=np.zeros_like(sums[..., :-1]), where=weight > 0)


def grow_level(trees: Trees, bins: Bins, rule: Rule, nodes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut ``nodes`` by their ``sums``: (children, their sums)."""
    gain, feature, cut, sides = best_cuts(sums, bins, rule, trees.path[nodes])
    good = gain > -np.inf
    children = trees.split(nodes[good], feature[good], cut[good], _values(sides[good], rule))
    return children, sides[good].reshape(len(children), sums.shape[-1])


# boosting -----------------------------------------------------------------------------
@dataclass
class Boost:
    """What one boosted fit is: its place in the grid and the fold it leaves out (-1: none)."""

    depth: int
    rate: float
    fold: int


def _gradients(scores: np.ndarray, label: np.ndarray, classes: int, quantum: float) -> tuple[np.ndarray, np.ndarray]:
    """Negative first and second derivatives of the loss, fits x classes x rows, as multiples of ``quantum``."""
    if not classes:
        g, h = label - scores, np.ones_like(scores)
    elif classes == 2:
        p = 1 / (1 + np.exp(-scores))
        g, h = label - p, np.maximum(p * (1 - p), 1e-16)
    else:
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        g, h = (label == np.arange(classes)[:, None]) - p, np.maximum(2 * p * (1 - p), 1e-16)
    return np.rint(g / quantum) * quantum, np.maximum(np.rint(h / quantum), 1) * quantum


def _quantum(largest: float, rows: int) -> float:
    """A power of two that is small beside ``largest`` while sums over ``rows`` rows stay exact in 53 bits."""
    return 2.0 ** (math.ceil(math.log2(max(largest, 1e-300) * max(rows, 1))) - 50)


def boosted_scores(scores: np.ndarray, classes: int) -> np.ndarray:
    """Predictions (fits x rows) from scores (fits x classes x rows)."""
    if not classes:
        return scores[:, 0]
    return (scores[:, 0] > 0).astype(float) if classes == 2 else scores.argmax(axis=1).astype(float)


class Together:
    """One task's share of boosting: fits side by side over the rows of one chunk."""

    def __init__(self, chunk: Chunk, fits: Sequence[Boost], classes: int, base: np.ndarray, quantum: float):
        self.outputs = classes if classes > 2 else 1
        self.fold = np.array([f.fold for f in fits])[:, None]
        self.rate = np.repeat([f.rate for f in fits], self.outputs)[:, None]
        self.chunk, self.classes, self.quantum = chunk, classes, quantum
        if chunk.scores is None:
            start = np.broadcast_to(base[:, None, None], (len(fits), self.outputs, len(chunk.label)))
            self.chunk = Chunk(chunk.bins, chunk.label, chunk.fold, chunk.row, start.copy())
        self.turn()

    def turn(self) -> None:
        c = self.chunk
        g, h = _gradients(c.scores, c.label, self.classes, self.quantum)
        inside = np.repeat(c.fold != self.fold, self.outputs, axis=0)
        self.weights = [g.reshape(inside.shape), np.where(inside, h.reshape(inside.shape), 0)]
        self.node = None

    def sums(self, bins: Bins, trees: Trees, nodes: np.ndarray) -> np.ndarray:
        """Gradient sums of ``nodes`` by bin; rows go on from where the level before left them."""
        slots = np.full(len(trees.feature), -1, np.int64)
        slots[nodes] = np.arange(len(nodes))
        start = np.repeat(trees.roots[:, None], len(self.chunk.label), axis=1) if self.node is None else self.node
        self.node = trees.route(self.chunk.bins, start)
        slot = np.where(self.weights[-1] > 0, slots[self.node], -1)
        return add_up(bins, self.chunk.bins, slot, self.weights, len(nodes))

    def advance(self, trees: Trees) -> None:
        """Add the trees of a round to the scores."""
        c = self.chunk
        leaf = trees.route(c.bins, np.repeat(trees.roots[:, None], len(c.label), axis=1))
        step = (self.rate * trees.value[leaf, 0]).reshape(c.scores.shape)
        self.chunk = Chunk(c.bins, c.label, c.fold, c.row, c.scores + step)
        self.turn()

    def quality(self) -> np.ndarray:
        """(sum of squared errors or hits, rows) of the rows each fit leaves out."""
        c, out = self.chunk, self.chunk.fold == self.fold
        guess = boosted_scores(c.scores, self.classes)
        value = (guess == c.label) if self.classes else (guess - c.label) ** 2
        return np.stack([(value * out).sum(1), out.sum(1)], 1)


class Placed(Together):
    """Boosting over places: ``rows`` and, for numbers, ``total`` and ``inner`` hold sums by fold and place.

    Classes: ``rows`` is (folds + 1) x classes x places.  Numbers: rows, sums of labels less ``center`` as multiples of the
    quantum, and squares about their mean, each (folds + 1) x 1 x places.  The last fold is of rows that no fit leaves out.
    """

    def __init__(self, places: Places, stats: list[np.ndarray], center: float, fits: Sequence[Boost], classes: int, base: np.ndarray, quantum: float):
        self.stats, self.center = stats, center
        self.left_out = [f.fold for f in fits]
        self.kept = [s.sum(axis=0) - np.stack([s[f] if f >= 0 else np.zeros_like(s[0]) for f in self.left_out]) for s in stats]
        none = np.zeros(len(places.keys))
        super().__init__(Chunk(places.bins, none, none, none), fits, classes, base, quantum)

    def turn(self) -> None:
        scores, rows = self.chunk.scores, self.kept[0]
        if self.classes:
            g = h = 0.0
            for k in range(self.classes):
                one, weight = _gradients(scores, np.full(scores.shape[-1], float(k)), self.classes, self.quantum)
                g, h = g + rows[:, k : k + 1] * one, h + rows[:, k : k + 1] * weight
        else:
            g = self.kept[1] - rows * (np.rint((scores - self.center) / self.quantum) * self.quantum)
            h = rows * np.maximum(np.rint(1.0 / self.quantum), 1) * self.quantum
        shape = (-1, scores.shape[-1])
        self.weights = [g.reshape(shape), h.reshape(shape)]
        self.node = None

    def quality(self) -> np.ndarray:
        guess, out = boosted_scores(self.chunk.scores, self.classes), []
        for i, fold in enumerate(self.left_out):
            if fold < 0:
                out.append((0.0, 0.0))
                continue
            rows = self.stats[0][fold]
            if self.classes:
                value = rows[guess[i].astype(int), np.arange(rows.shape[1])].sum()
            else:
                mean = np.divide(self.stats[1][fold][0], rows[0], out=np.zeros(rows.shape[1]), where=rows[0] > 0)
                value = (self.stats[2][fold][0] + rows[0] * (guess[i] - self.center - mean) ** 2).sum()
            out.append((value, rows.sum()))
        return np.array(out)


def place_sums(chunks: RDD, bins: Bins, places: Places, folds: int, classes: int, center: float, quantum: float) -> list[np.ndarray]:
    """What ``Placed`` needs, added up in one pass, and one more for numbers."""
    size = len(places.keys)

    def by_place(values: Callable[[Chunk, np.ndarray], list[tuple[np.ndarray, np.ndarray | None]]], width: int, parts: int) -> np.ndarray:
        def run(held: Iterator[Chunk]) -> Iterator[np.ndarray]:
            total = np.zeros((parts, (folds + 1) * width * size))
            for c in held:
                fold = np.where((c.fold >= 0) & (c.fold < folds), c.fold, folds).astype(np.int64)
                place = places.of(bins, c.bins)
                for part, (kind, w) in enumerate(values(c, fold * size + place)):
                    total[part] += np.bincount((fold * width + kind) * size + place, w, total.shape[1])
            yield total

        return summed(chunks.mapPartitions(run)).reshape(parts, folds + 1, width, size)

    if classes:
        return list(by_place(lambda c, at: [(c.label.astype(np.int64), None)], classes, 1))

    def label(c: Chunk) -> np.ndarray:
        return np.rint((c.label - center) / quantum) * quantum

    rows, total = by_place(lambda c, at: [(0, None), (0, label(c))], 1, 2)
    mean = np.divide(total, rows, out=np.zeros_like(total), where=rows > 0).ravel()
    (inner,) = by_place(lambda c, at: [(0, (c.label - center - mean[at]) ** 2)], 1, 1)
    return [rows, total, inner]


class Passes:
    """The same over all chunks of an RDD: a pass adds up a level, and the scores are a new state in every round.

    A state stays with the executors and is cut off from its history through the checkpoint folder every few rounds.
    """

    def __init__(self, chunks: RDD, *setting) -> None:
        self.begin = lambda c: Together(c, *setting)
        begin = self.begin
        self.state = chunks.map(lambda c: begin(c).chunk).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None
        self.turns = 0

    def sums(self, bins: Bins, trees: Trees, nodes: np.ndarray) -> np.ndarray:
        begin, empty = self.begin, np.zeros((len(nodes), bins.total, 2))
        found = summed(self.state.mapPartitions(lambda held: [sum((begin(c).sums(bins, trees, nodes) for c in held), empty)]))
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return found

    def advance(self, trees: Trees) -> None:
        begin = self.begin

        def after(c: Chunk) -> Chunk:
            share = begin(c)
            share.advance(trees)
            return share.chunk

        self.before, self.state = self.state, self.state.map(after).persist(StorageLevel.MEMORY_AND_DISK)
        self.turns += 1
        if self.turns % CHECKPOINT_ROUNDS == 0:
            self.state.checkpoint()

    def quality(self) -> np.ndarray:
        begin = self.begin
        return summed(self.state.mapPartitions(lambda held: [sum(begin(c).quality() for c in held)]))


def boost_rounds(side: Together | Passes, bins: Bins, fits: Sequence[Boost], rounds: int, outputs: int, marks: Sequence[int]) -> tuple[list[Trees], dict[int, np.ndarray]]:
    """The trees of each round, and the quality after ``marks`` rounds."""
    rule = Rule(LAMBDA, LEAST_WEIGHT, LEAST_GAIN)
    deep = np.repeat([f.depth for f in fits], outputs)
    made, scored = [], {}
    for turn in range(1, rounds + 1):
        trees = Trees.stumps(len(fits) * outputs, 1)
        nodes, owner = trees.roots, np.arange(len(trees.roots))
        for level in range(int(deep.max())):
            deeper = deep[owner] > level
            nodes, owner = nodes[deeper], owner[deeper]
            if not len(nodes):
                break
            below, owners = [], []
            step = max(1, PASS_CELLS // (2 * bins.total))
            for at in range(0, len(nodes), step):
                part = nodes[at : at + step]
                sums = side.sums(bins, trees, part)
                if level == 0:
                    trees.value[part] = _values(sums[:, : bins.offsets[1]].sum(axis=1), rule)
                children, _ = grow_level(trees, bins, rule, part, sums)
                below.append(children)
                owners.append(np.repeat(owner[at : at + step][trees.left[part] >= 0], 2))
            nodes, owner = np.concatenate(below), np.concatenate(owners)
        made.append(trees)
        side.advance(trees)
        if turn in marks:
            scored[turn] = side.quality()
    return made, scored


def boost(
    chunks: RDD, bins: Bins, fits: Sequence[Boost], rounds: int, classes: int, base: np.ndarray, largest: float, rows: int, marks: Sequence[int], local_rows: int = LOCAL_ROWS
) -> tuple[list[list[Trees]], dict[int, np.ndarray]]:
    """Boost all ``fits``: the trees of every fit, output by output and round by round, and their quality after ``marks`` rounds.

    All rows of a fit are in its root.  If they are no more than ``local_rows``, the root is finished by one task as in a forest,
    and with it all rounds; tasks then take some fits each.  Otherwise each level is a pass over all rows.
    """
    outputs = classes if classes > 2 else 1
    quantum = _quantum(largest, rows)

    def split(made: list[Trees], i: int) -> list[Trees]:
        return [_joined(t, i * outputs + o, {}) for t in made for o in range(outputs)]

    places = Places.found(chunks, bins, local_rows) if rows > local_rows else None
    if rows > local_rows and places is None:
        made, scored = boost_rounds(Passes(chunks, fits, classes, base, quantum), bins, fits, rounds, outputs, marks)
        return [split(made, i) for i in range(len(fits))], scored

    groups = min(len(fits), 3 * chunks.context.defaultParallelism)
    by_depth = sorted(range(len(fits)), key=lambda i: -fits[i].depth)
    shares = [by_depth[g::groups] for g in range(groups)]

    def finished(share: int, side: Together) -> Iterator[tuple[int, list[Trees], dict[int, np.ndarray]]]:
        made, scored = boost_rounds(side, bins, [fits[i] for i in shares[share]], rounds, outputs, marks)
        for at, i in enumerate(shares[share]):
            yield i, split(made, at), {m: s[at] for m, s in scored.items()}

    def run(item: tuple[int, Iterator[Chunk]]) -> Iterator[tuple[int, list[Trees], dict[int, np.ndarray]]]:
        share, parts = item
        parts = list(parts)
        chunk = Chunk(*[np.concatenate([getattr(c, k) for c in parts]) for k in ("bins", "label", "fold", "row")])
        return finished(share, Together(chunk, [fits[i] for i in shares[share]], classes, base[shares[share]], quantum))

    if places is not None:
        center = 0.0 if classes else float(np.mean(base))
        stats = place_sums(chunks, bins, places, max(f.fold for f in fits) + 1, classes, center, quantum)
        held = chunks.context.broadcast((places.keys, places.bins, stats))  # at most ``local_rows`` places

        def run_placed(share: int) -> Iterator[tuple[int, list[Trees], dict[int, np.ndarray]]]:
            at, (keys, data, sums) = shares[share], held.value
            return finished(share, Placed(Places(keys, data), sums, center, [fits[i] for i in at], classes, base[at], quantum))

        tasks = chunks.context.parallelize(range(groups), groups).flatMap(run_placed)
    else:
        dealt = chunks.flatMap(lambda c: [(g, c) for g in range(groups)]).groupByKey(groups, partitionFunc=lambda g: g)
        tasks = dealt.flatMap(run)
    found = sorted(tasks.collect(), key=lambda r: r[0])  # fitted models
    return [t for _, t, _ in found], {m: np.stack([s[m] for _, _, s in found]) for m in marks}


# forests ------------------------------------------------------------------------------
def _least_over(edge: float) -> int:
    """The least 64-bit value that is, divided by 2**64 as a float, not below ``edge``."""
    low, high = 0, (1 << 64) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if float(middle) / 2.0**64 >= edge else (middle + 1, high)
    return low


#: from which hash on a row is drawn once, twice, ...: Poisson with mean 1
_DRAWN_FROM = np.array([_least_over(e) for e in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])], np.uint64)
_SEVERAL = 255  # hashes with the same first bits are drawn differently often
_BY_FIRST_BITS = np.searchsorted(_DRAWN_FROM, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48), side="right").astype(np.uint8)
_BY_FIRST_BITS[(_DRAWN_FROM >> np.uint64(48)).astype(int)] = _SEVERAL


def _drawn(hashes: np.ndarray) -> np.ndarray:
    """How often rows of some hashes are drawn."""
    times = _BY_FIRST_BITS[(hashes >> np.uint64(48)).astype(np.uint16)]
    several = times == _SEVERAL
    times[several] = np.searchsorted(_DRAWN_FROM, hashes[several], side="right")
    return times


def draws(row: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """How often each tree (rows of the result) draws each row: Poisson with mean 1, from a hash of both."""
    return _drawn(mixed(mixed(row.astype(np.uint64))[None, :] + mixed(trees.astype(np.uint64) + np.uint64(1))[:, None])).astype(float)


def _sorted_cuts(
    held: np.ndarray, data: np.ndarray, weights: np.ndarray, starts: np.ndarray, rule: Rule, path: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``best_cuts`` finds, from rows in order of node and bin: only bins that a node's rows have are looked at.

    ``held`` (features x rows) has the rows of each node, from ``starts`` on, ordered by each feature's bin; weights are rows x channels.
    """
    nodes, features = len(path), len(held)
    sizes = np.diff(starts)
    node = np.repeat(np.arange(nodes), sizes)
    found = []
    for f in range(features):
        bin_of, running = data[held[f], f], weights[held[f]].cumsum(axis=0)
        before = np.concatenate([np.zeros_like(running[:1]), running[starts[1:-1] - 1]])
        if f == 0:
            whole = running[starts[1:] - 1] - before
        ends = np.flatnonzero((bin_of[1:] != bin_of[:-1]) & (node[1:] == node[:-1]))
        found.append((node[ends], np.full(len(ends), f), bin_of[ends], running[ends] - before[node[ends]]))
    at, feature, cut, left = (np.concatenate(c) for c in zip(*found))
    right = whole[at] - left

    def worth(s: np.ndarray) -> np.ndarray:
        weight = s[..., -1] + rule.penalty
        return np.divide((s[..., :-1] ** 2).sum(-1), weight, out=np.zeros_like(weight), where=weight > 0)

    gain = worth(left) + worth(right) - worth(whole)[at]
    fits = (left[:, -1] >= rule.least_weight) & (right[:, -1] >= rule.least_weight) & (gain > rule.least_gain)
    if rule.features:
        usable = np.zeros((nodes, features), bool)
        usable[at[fits], feature[fits]] = True
        fits &= _looked_at(usable, rule, path)[at, feature]
    chosen = np.flatnonzero(fits)
    best, first = np.full(nodes, -np.inf), np.full(nodes, -1)
    np.maximum.at(best, at[chosen], gain[chosen])
    chosen = chosen[gain[chosen] == best[at[chosen]]][::-1]
    first[at[chosen]] = chosen  # of equal gains the first in order of feature and bin stays
    good = np.flatnonzero(first >= 0)
    first = first[good]
    return good, feature[first], cut[first], np.stack([left[first], right[first]], 1)


def grow_alone(data: np.ndarray, weights: list[np.ndarray], rule: Rule, root: Trees, depth: int) -> Trees:
    """A tree grown to ``depth`` levels below its root from rows that one task holds.

    Rows stay sorted by node and by each feature's bin, so a level takes time by its rows and not by its nodes times all bins.
    """
    trees, nodes, given = root, np.zeros(1, np.int64), np.stack(weights, 1)
    rows = np.flatnonzero(given[:, -1] > 0)
    held = np.stack([rows[data[rows, f].argsort(kind="stable")] for f in range(data.shape[1])]) if data.shape[1] else np.zeros((0, 0), int)
    starts = np.array([0, len(rows)])
    for _ in range(depth):
        if not held.size:
            break
        good, feature, cut, sides = _sorted_cuts(held, data, given, starts, rule, trees.path[nodes])
        if not len(good):
            break
        sizes = np.diff(starts)
        node = np.repeat(np.arange(len(nodes)), sizes)
        nodes = trees.split(nodes[good], feature, cut, _values(sides, rule))
        # rows of the nodes that were cut stay, those that go left before the others
        kept = np.zeros(len(sizes), bool)
        kept[good] = True
        inside, sizes = kept[node], sizes[good]
        held = held[:, inside]
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        owner = np.repeat(np.arange(len(good)), sizes)
        at = held[0]
        goes_right = np.zeros(len(data), bool)
        goes_right[at] = data[at, feature[owner]] > cut[owner]
        right = goes_right[held]
        rights = right.cumsum(axis=1) - right
        rights -= rights[:, begin][:, owner]  # those before a row within its node
        lefts = sizes - np.add.reduceat(right[0], begin, dtype=np.int64)
        place = np.arange(len(owner))
        place = np.where(right, (begin + lefts)[owner] + rights, place - rights)
        moved = np.empty_like(held)
        np.put_along_axis(moved, place, held, axis=1)
        held = moved
        starts = np.concatenate([np.column_stack([begin, begin + lefts]).ravel(), [len(owner)]])
    return trees


def _forest_terms(classes: int, center: float, largest: float, rows: int, features: int) -> tuple[Callable[[np.ndarray], np.ndarray], Rule]:
    """What labels count as in sums, and how a forest's nodes are cut."""
    quantum = _quantum(1.0 if classes else largest, 4 * rows)

    def counted(label: np.ndarray) -> np.ndarray:
        return label if classes else np.rint((label - center) / quantum) * quantum

    return counted, Rule(0.0, 1.0, 1e-12 * (1.0 if classes else max(largest, 1e-150) ** 2), features)


def forest(
    chunks: RDD, bins: Bins, folds: Sequence[int], n_trees: int, depth: int, classes: int, center: float, largest: float, rows: int, features: int, local_rows: int = LOCAL_ROWS
) -> dict[tuple[int, int], Trees]:
    """(fold left out, tree number) -> tree, ``n_trees`` for each of ``folds`` (-1: none), cut until nothing can be gained.

    Nodes with more than ``local_rows`` drawn rows are cut by passes over all rows, level by level; the rows of a smaller one are
    sent to one task, which finishes it.
    """
    keys = [(f, t) for f in folds for t in range(n_trees)]
    fold, number = (np.array(c) for c in zip(*keys))
    channels = classes or 1
    counted, rule = _forest_terms(classes, center, largest, rows, features)

    def weights(c: Chunk, chosen: slice | np.ndarray = slice(None)) -> list[np.ndarray]:
        times = np.where(c.fold != fold[chosen][:, None], draws(c.row, number[chosen]), 0)
        return [*([times * (c.label == k) for k in range(classes)] if classes else [times * counted(c.label)]), times]

    trees = Trees.stumps(len(keys), channels, mixed(number.astype(np.uint64) + np.uint64(7)))

    places = Places.found(chunks, bins, local_rows) if rows > local_rows else None
    if places is not None:
        return dict(_trees_of_places(chunks, bins, places, folds, n_trees, depth, classes, counted, rule, rows).collect())  # fitted models

    def totals(held: Iterator[Chunk]) -> Iterator[np.ndarray]:
        yield sum((np.stack([w.sum(1) for w in weights(c)], 1) for c in held), np.zeros((len(keys), channels + 1)))

    sums = summed(chunks.mapPartitions(totals))
    trees.value[:] = _values(sums, rule)
    nodes, owner, level = trees.roots, np.arange(len(keys)), 0
    small: list[tuple[int, int, int]] = []
    while len(nodes):
        large = sums[:, -1] > local_rows
        small += [(int(o), int(n), level) for o, n in zip(owner[~large], nodes[~large])]
        nodes, owner = nodes[large], owner[large]
        if level == depth or not len(nodes):
            break
        children, owners, below_sums = [], [], []
        for part, part_sums in level_sums(chunks, bins, trees, nodes, weights, channels + 1):
            below, sides = grow_level(trees, bins, rule, part, part_sums)
            children.append(below)
            below_sums.append(sides)
            at = np.searchsorted(nodes, part)
            owners.append(np.repeat(owner[at[trees.left[part] >= 0]], 2))
        nodes, owner, sums = np.concatenate(children), np.concatenate(owners), np.concatenate(below_sums)
        level += 1
    subtrees = _finished(chunks, bins, trees, small, weights, rule, depth)
    return {key: _joined(trees, i, subtrees) for i, key in enumerate(keys)}


@dataclass
class Draws:
    """Rows by cell (fold, class and place), of which each tree draws some."""

    cells: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    label: np.ndarray | None

    @staticmethod
    def of(cell: np.ndarray, row: np.ndarray, label: np.ndarray | None) -> Draws:
        order = cell.argsort(kind="stable")
        cell = cell[order]
        ends = np.flatnonzero(np.concatenate([cell[1:] != cell[:-1], [True]]))
        return Draws(cell[ends], ends, mixed(row[order].astype(np.uint64)), None if label is None else label[order])

    def _by_cell(self, value: np.ndarray, kind: type) -> np.ndarray:
        running = value.cumsum(dtype=kind)[self.ends]
        return np.diff(running, prepend=running.dtype.type(0))

    def sums(self, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """How many rows each of ``trees`` draws of each cell, and what their labels add up to; exact as all sums."""
        count = np.zeros((len(trees), len(self.cells)), np.uint32)
        total = None if self.label is None else np.zeros(count.shape)
        times = np.empty(len(self.row), np.uint8)
        for i, seed in enumerate(mixed(trees.astype(np.uint64) + np.uint64(1))):
            for at in range(0, len(times), CHUNK_ROWS):
                times[at : at + CHUNK_ROWS] = _drawn(mixed(self.row[at : at + CHUNK_ROWS] + seed))
            count[i] = self._by_cell(times, np.uint32)
            if total is not None:
                total[i] = self._by_cell(times * self.label, float)
        return count, total


def _small(values: np.ndarray) -> tuple[bytes, str]:
    """Whole numbers in few bytes."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return zlib.compress(values.astype(kind).tobytes(), 1), kind.str


def _restored(given: tuple[bytes, str]) -> np.ndarray:
    return np.frombuffer(zlib.decompress(given[0]), given[1])


def _trees_of_places(
    chunks: RDD, bins: Bins, places: Places, folds: Sequence[int], n_trees: int, depth: int, classes: int, counted: Callable[[np.ndarray], np.ndarray], rule: Rule, rows: int
) -> RDD:
    """((fold, tree number), tree) of a table with few places, from the sums of what each tree draws by fold and place.

    Sums are made where the rows are, of up to ``DRAWN_ROWS`` at a time, and only they are shuffled; a task then grows some trees.
    """
    size, parts, width = len(places.keys), max(folds) + 2, classes or 1
    parallelism = chunks.context.defaultParallelism
    groups = min(n_trees, 3 * parallelism)
    held = chunks.context.broadcast((places.keys, places.bins))

    def compact(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        fold = np.where((c.fold >= 0) & (c.fold < parts - 1), c.fold, parts - 1).astype(np.int64)
        kind = c.label.astype(np.int64) if classes else 0
        cell = (fold * width + kind) * size + Places(*held.value).of(bins, c.bins)
        return cell.astype(np.int32), c.row, None if classes else counted(c.label)

    def summed_up(given: list[tuple]) -> Iterator[tuple[int, tuple]]:
        cell, row, label = (None if c[0] is None else np.concatenate(c) for c in zip(*given))
        given.clear()
        drawn = Draws.of(cell, row, label)
        cells = _small(np.diff(drawn.cells, prepend=0))
        for group in range(groups):
            count, total = drawn.sums(np.arange(group, n_trees, groups))
            yield group, (cells, _small(count), total)

    def draw(held_chunks: Iterator[Chunk]) -> Iterator[tuple[int, tuple]]:
        waiting, n = [], 0
        for c in held_chunks:
            waiting.append(compact(c))
            n += len(c.label)
            if n >= DRAWN_ROWS:
                yield from summed_up(waiting)
                n = 0
        if n:
            yield from summed_up(waiting)

    def grow(group: int, given: Iterator[tuple[int, tuple]]) -> Iterator[tuple[tuple[int, int], Trees]]:
        own = np.arange(group, n_trees, groups)
        drawn = np.zeros((len(own), parts * width * size))
        label_sums = None if classes else np.zeros_like(drawn)
        for _, (cells, count, total) in given:
            at = _restored(cells).cumsum(dtype=np.int64)
            count = _restored(count).reshape(len(own), len(at))
            for i in range(len(own)):
                drawn[i, at] += count[i]
                if total is not None:
                    label_sums[i, at] += total[i]
        for i, tree in enumerate(own):
            by_class = drawn[i].reshape(parts, width, size)
            channels = [*(by_class.transpose(1, 0, 2) if classes else [label_sums[i].reshape(parts, size)]), by_class.sum(axis=1)]
            for fold in folds:
                inside = [c.sum(axis=0) - (c[fold] if fold >= 0 else 0) for c in channels]
                root = Trees.stumps(1, width, mixed(np.array([tree], np.uint64) + np.uint64(7)))
                root.value[:] = _values(np.array([c.sum() for c in inside])[None], rule)
                yield (fold, int(tree)), grow_alone(held.value[1], inside, rule, root, depth)

    tasks = max(parallelism, -(-rows // DRAWN_ROWS))
    dealt = chunks.coalesce(tasks) if chunks.getNumPartitions() > tasks else chunks
    return dealt.mapPartitions(draw).partitionBy(groups, lambda g: g).mapPartitionsWithIndex(grow)


def _finished(chunks: RDD, bins: Bins, trees: Trees, small: list[tuple[int, int, int]], weights, rule: Rule, depth: int) -> dict[int, Trees]:
    """node -> the tree below it, each grown in one task from the rows that reach it."""
    spots: dict[int, list[tuple[int, int]]] = {}
    for owner, node, level in small:
        spots.setdefault(owner, []).append((node, level))

    def sent(c: Chunk) -> Iterator[tuple[int, tuple[np.ndarray, list[np.ndarray]]]]:
        for owner, places in spots.items():
            w = weights(c, np.array([owner]))
            node = trees.route(c.bins, np.full((1, len(c.label)), trees.roots[owner]))[0]
            for place, _ in places:
                rows = np.flatnonzero((node == place) & (w[-1][0] > 0))
                if len(rows):
                    yield place, (c.bins[rows], [x[0, rows] for x in w])

    depth_of = {node: level for _, node, level in small}

    def finish(item: tuple[int, Iterator]) -> tuple[int, Trees]:
        place, parts = item
        data, given = zip(*parts)
        root = Trees.stumps(1, trees.value.shape[1], trees.path[[place]])
        root.value[0] = trees.value[place]
        stacked = [np.concatenate(w) for w in zip(*given)]
        return place, grow_alone(np.concatenate(data), stacked, rule, root, depth - depth_of[place])

    tasks = max(chunks.getNumPartitions(), min(len(small), 4 * chunks.context.defaultParallelism))
    return dict(chunks.flatMap(sent).groupByKey(tasks).map(finish).collect())


def _joined(trees: Trees, tree: int, subtrees: dict[int, Trees]) -> Trees:
    """One tree of its own with the finished parts below it."""
    feature, cut, left, value = [], [], [], []
    todo: list[tuple[Trees, int, int]] = []

    def put(source: Trees, node: int) -> None:
        if source is trees and node in subtrees:
            source, node = subtrees[node], 0
        todo.append((source, node, len(feature)))
        feature.append(source.feature[node])
        cut.append(source.cut[node])
        left.append(-1)
        value.append(source.value[node])

    put(trees, int(trees.roots[tree]))
    at = 0
    while at < len(todo):
        source, node, here = todo[at]
        at += 1
        if source.feature[node] >= 0:
            left[here] = len(feature)
            below = int(source.left[node])
            put(source, below)
            put(source, below + 1)
    n = len(feature)
    return Trees(np.zeros(1, np.int64), np.array(feature, np.int32), np.array(cut, np.uint8), np.array(left, np.int32), np.array(value).reshape(n, trees.value.shape[1]), np.zeros(n, np.uint64))


def forest_sums(made: Sequence[Trees], bins: np.ndarray, counts: Sequence[int], depths: Sequence[int]) -> np.ndarray:
    """Mean values (counts x depths x rows x channels) of the first trees, each read at the given depths (ascending)."""
    total, out = None, []
    for i, tree in enumerate(made, 1):
        node, read, level = np.zeros((1, len(bins)), np.int64), [], 0
        for depth in depths:
            node = tree.route(bins, node, depth - level)
            level = depth
            read.append(tree.value[node[0]])
        total = np.stack(read) if total is None else total + np.stack(read)
        if i in counts:
            out.append(total / i)
    return np.stack(out)


# models -------------------------------------------------------------------------------
def _packed(arrays: Mapping[str, np.ndarray]) -> str:
    held = io.BytesIO()
    np.savez_compressed(held, **arrays)
    return base64.b64encode(held.getvalue()).decode()


@dataclass
class Leaves:
    """Trees as they are shipped to the rows they predict: values of leaves only, numbers as small as they fit."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray, depth: int) -> Leaves:
        """Trees side by side, each with its children counted from its root; nodes ``depth`` levels below are leaves."""
        roots = np.cumsum(sizes) - sizes
        start, feature, nodes, level = np.repeat(roots, sizes), feature.copy(), roots, 0
        while len(nodes):
            if level == depth:
                feature[nodes] = -1
            nodes = nodes[feature[nodes] >= 0]
            nodes = (start[nodes] + left[nodes])[:, None] + np.array([0, 1])
            nodes, level = nodes.ravel(), level + 1
        leaf = feature < 0
        # a child of an inner node, the place of a leaf's value
        below = np.where(leaf, np.cumsum(leaf) - 1, start + left)
        kinds = [np.result_type(np.min_scalar_type(int(a.max(initial=0))), np.int8) for a in (feature, below)]
        return Leaves(roots, feature.astype(kinds[0]), cut, below.astype(kinds[1]), value[leaf])

    def read(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The values of a tree for some rows."""
        columns, at = bins.T, np.arange(len(bins))
        node = np.full(len(bins), self.roots[tree])
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return self.value[self.below[node]]
            right = columns[np.maximum(feature, 0), at] > self.cut[node]
            node = np.where(inner, self.below[node] + right, node)


class TreeModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble: a transformer from ``features`` to ``prediction`` that can be saved in a pipeline."""

    payload = Param(Params._dummy(), "payload", "arrays of the trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, payload: str = ""):
        super().__init__()
        self._set(payload=payload)

    @staticmethod
    def of(bins: Bins, made: Sequence[Trees], classes: int, base: float, rates: float, outputs: int, depth: int) -> TreeModel:
        """``outputs`` > 0: boosted trees, one per output and round; 0: a forest."""
        sizes = [len(t.feature) for t in made]
        joined = {k: np.concatenate([getattr(t, k) for t in made]) for k in ("feature", "cut", "left", "value")}
        cuts = [len(c) for c in bins.cuts]
        plain = {"sizes": sizes, "cut_sizes": cuts, "cuts": np.concatenate(bins.cuts), "head": [classes, base, rates, outputs, min(depth, 1 << 30)]}
        return TreeModel(payload=_packed({**joined, **{k: np.array(v) for k, v in plain.items()}}))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.payload))))
        bins = Bins(np.split(held["cuts"], np.cumsum(held["cut_sizes"])[:-1]))
        classes, base, rate, outputs, depth = held["head"].tolist()
        classes, outputs, depth = int(classes), int(outputs), int(depth)
        leaves = Leaves.of(*[held[k] for k in ("sizes", "feature", "cut", "left", "value")], depth)

        def predict(values: np.ndarray) -> np.ndarray:
            data = bins.of(values)
            if not outputs:
                mean = sum(leaves.read(i, data) for i in range(len(leaves.roots))) / len(leaves.roots)
                return mean.argmax(1).astype(float) if classes else mean[:, 0] + base
            scores = np.full((1, outputs, len(data)), base)
            for i in range(len(leaves.roots)):
                scores[0, i % outputs] += rate * leaves.read(i, data)[:, 0]
            return boosted_scores(scores, classes)[0]

        @F.pandas_udf("double")
        def predicted(features: pd.Series) -> pd.Series:
            return pd.Series(predict(np.stack(features.to_numpy())) if len(features) else [], dtype=float)

        return dataset.withColumn("prediction", predicted(vector_to_array("features")))


@dataclass
class TreeTable:
    """The byte table of a search and what is known of its labels."""

    chunks: RDD
    bins: Bins
    rows: int
    classes: int
    means: list[float]
    largest: float
    written: DataFrame

    def discard(self) -> None:
        self.chunks.unpersist()
        discard(self.written)


def tree_table(train: DataFrame, module: str, folds: int, bins: int = BINS) -> TreeTable:
    """Bin ``train`` (features, label, fold, row); ``means`` has the label mean outside each fold and, last, of all rows."""
    ensure_checkpointing(train.sparkSession)
    found = fit_bins(train, bins)
    outside = [F.avg(F.when(F.col("fold") != f, F.col("label"))) for f in range(folds)] + [F.avg("label")]
    n, top, low, means = train.agg(F.count("*"), F.max("label"), F.min("label"), F.array(*outside)).first()
    classes = max(2, int(top or 0) + 1) if module == "classification" else 0
    means = [m or 0.0 for m in means]
    chunks, written = binned(train, found)
    return TreeTable(chunks, found, n, classes, means, max((abs((x or 0.0) - m) for x in (top, low) for m in means), default=0.0), written)


def _mean_scores(totals: np.ndarray, classes: int) -> float:
    """Mean over folds of accuracy or negative RMSE from (sum, rows) per fold."""
    mean = totals[:, 0] / np.maximum(totals[:, 1], 1)
    return float(mean.mean() if classes else -np.sqrt(mean).mean())


def search_boosted(train: DataFrame, module: str, candidates: Sequence[Mapping], folds: int, local_rows: int = LOCAL_ROWS) -> tuple[list[float], TreeModel]:
    """Mean score of every point, and the best one's model on all rows; points that differ in rounds only share their fits."""
    table = tree_table(train, module, folds)
    marks = sorted({c["n_estimators"] for c in candidates})
    grid = sorted({(c["max_depth"], c["learning_rate"]) for c in candidates})
    fits = [Boost(d, r, f) for d, r in grid for f in [*range(folds), -1]]
    base = np.zeros(len(fits)) if table.classes else np.array([table.means[f.fold] for f in fits])
    # residuals of a fit that overshoots stay within a few times the spread of the labels
    largest = 1.0 if table.classes else 8 * table.largest
    made, scored = boost(table.chunks, table.bins, fits, marks[-1], table.classes, base, largest, table.rows, marks, local_rows)
    table.discard()
    places = [grid.index((c["max_depth"], c["learning_rate"])) * (folds + 1) for c in candidates]
    means = [_mean_scores(scored[c["n_estimators"]][p : p + folds], table.classes) for c, p in zip(candidates, places)]
    best = max(range(len(candidates)), key=lambda i: (means[i], -i))
    outputs = table.classes if table.classes > 2 else 1
    whole = places[best] + folds
    chosen = made[whole][: candidates[best]["n_estimators"] * outputs]
    rate = candidates[best]["learning_rate"]
    return means, TreeModel.of(table.bins, chosen, table.classes, float(base[whole]), rate, outputs, 1 << 30)


def _place_quality(
    table: TreeTable, places: Places, folds: int, counts: Sequence[int], depths: Sequence[int], center: float, features: int
) -> np.ndarray:
    """(sum of squared errors or hits, rows) by fold, count and depth: the trees stay in the tasks that grow them.

    Only their values by place are added up, as multiples of a power of two, so that the order of trees does not matter.
    """
    classes, channels = table.classes, table.classes or 1
    counted, rule = _forest_terms(classes, center, table.largest, table.rows, features)
    stats = place_sums(table.chunks, table.bins, places, folds, classes, center, _quantum(1.0 if classes else table.largest, 4 * table.rows))
    grown = _trees_of_places(table.chunks, table.bins, places, range(folds), counts[-1], depths[-1], classes, counted, rule, table.rows)
    held = table.chunks.context.broadcast((places.bins, stats))  # at most ``local_rows`` places
    quantum = _quantum(1.0 if classes else table.largest, counts[-1])

    def values(trees: Iterator[tuple[tuple[int, int], Trees]]) -> Iterator[tuple[int, np.ndarray]]:
        data = held.value[0]
        total = np.zeros((folds, len(counts), len(depths), len(data), channels))
        for (fold, number), tree in trees:
            node, level = np.zeros((1, len(data)), np.int64), 0
            for i, depth in enumerate(depths):
                node = tree.route(data, node, depth - level)
                level = depth
                total[fold, np.searchsorted(counts, number, side="right"), i] += np.rint(tree.value[node[0]] / quantum) * quantum
        yield from enumerate(total)

    def quality(item: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        fold, total = item
        mean = total.cumsum(axis=0) / np.array(counts)[:, None, None, None]
        rows, at = held.value[1][0][fold], np.arange(total.shape[2])
        if classes:
            value = rows[mean.argmax(3), at]
        else:
            label = np.divide(held.value[1][1][fold][0], rows[0], out=np.zeros(rows.shape[1]), where=rows[0] > 0)
            value = held.value[1][2][fold][0] + rows[0] * (mean[..., 0] - label) ** 2
        return fold, np.stack([value.sum(2), np.full(value.shape[:2], rows.sum())], 2)

    found = grown.mapPartitions(values).reduceByKey(lambda a, b: a + b, folds).map(quality).collect()
    return np.stack([q for _, q in sorted(found, key=lambda r: r[0])])


def search_forest(train: DataFrame, module: str, candidates: Sequence[Mapping], folds: int, local_rows: int = LOCAL_ROWS) -> tuple[list[float], TreeModel]:
    """Mean score of every point, and the best one's model on all rows, from one forest per fold and one of all rows.

    Only the forest of the best point comes to the driver, cut at its depth; where the table has many places, one fold's at a time.
    """
    table = tree_table(train, module, folds)
    counts = sorted({c["n_estimators"] for c in candidates})
    no_limit = 1 << 20
    depths = sorted({c["max_depth"] or no_limit for c in candidates})
    features = max(1, int(math.sqrt(len(table.bins.cuts)))) if table.classes else 0
    center = 0.0 if table.classes else table.means[-1]

    def grown(fold: int, n_trees: int, depth: int) -> list[Trees]:
        made = forest(table.chunks, table.bins, [fold], n_trees, depth, table.classes, center, table.largest, table.rows, features, local_rows)
        return [made[fold, t] for t in range(n_trees)]

    def row_quality(fold: int) -> np.ndarray:
        held = table.chunks.context.broadcast(grown(fold, counts[-1], depths[-1]))  # a fitted model

        def quality(chunks: Iterator[Chunk]) -> Iterator[np.ndarray]:
            total = np.zeros((len(counts), len(depths), 2))
            for c in chunks:
                rows = np.flatnonzero(c.fold == fold)
                if len(rows):
                    mean, label = forest_sums(held.value, c.bins[rows], counts, depths), c.label[rows]
                    value = (mean.argmax(3) == label) if table_classes else (mean[..., 0] + center - label) ** 2
                    total += np.stack([value.sum(2), np.full(value.shape[:2], len(rows))], 2)
            yield total

        table_classes = table.classes
        found = summed(table.chunks.mapPartitions(quality))
        held.unpersist()
        return found

    places = Places.found(table.chunks, table.bins, local_rows)
    if places is None:
        totals = np.stack([row_quality(fold) for fold in range(folds)])
    else:
        totals = _place_quality(table, places, folds, counts, depths, center, features)
    means = [
        _mean_scores(totals[:, counts.index(c["n_estimators"]), depths.index(c["max_depth"] or no_limit)], table.classes) for c in candidates
    ]
    best = max(range(len(candidates)), key=lambda i: (means[i], -i))
    point = candidates[best]
    depth = point["max_depth"] or no_limit
    chosen = grown(-1, point["n_estimators"], depth)
    table.discard()
    return means, TreeModel.of(table.bins, chosen, table.classes, center, 1.0, 0, depth)
