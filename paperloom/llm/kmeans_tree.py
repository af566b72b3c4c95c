"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Equal vectors are one candidate with their smallest ids, so copies cost one distance.  A bounded sample
is clustered into a tree whose inner nodes hold the centres of their children; every vector goes down to
the leaf of the nearest centres.  A query takes the tree's branches from a priority queue, nearest
centre first.  The first leaves give it a k-th distance; then it widens its search to every leaf that it
reaches through centres no farther than ``reach`` times that distance.  ``reach`` is calibrated: queries of a
bounded sample are compared with all vectors, and it is the least factor that finds the wanted
share of their true neighbours.  Leaves are met in blocks of bounded size, however many vectors or queries share one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import stage

SAMPLE = 8_192
LEAF_SAMPLE = 48
BRANCHES = 12
CALIBRATION = 256
RECALL = 0.97
FIRST_LEAVES = 3
BLOCK = 4_096
#: rounding of squared distances by the product form, relative to the squared norms
ROUNDING = 1e-12
KEY = ["ka", "kb"]
HIT = "array<struct<score:double,id:long>>"


@dataclass
class Tree:
    """``centres`` of all nodes but the root, their ``parent`` (-1: the root) and ``leaf`` number (-1: an inner node)."""

    centres: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray

    def __post_init__(self) -> None:
        self.children: dict[int, list[int]] = {}
        for node, parent in enumerate(self.parent.tolist()):
            self.children.setdefault(parent, []).append(node)

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors x nodes."""
        squares = (vectors**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * vectors @ self.centres.T
        return np.sqrt(np.maximum(squares, 0))

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every level."""
        at, out = np.full(len(vectors), -1), np.zeros(len(vectors), np.int64)
        todo = np.arange(len(vectors))
        while len(todo):
            for node in np.unique(at[todo]):
                rows = todo[at[todo] == node]
                below = np.array(self.children[int(node)])
                part = Tree(self.centres[below], np.full(len(below), -1), np.arange(len(below)))
                at[rows] = below[part.distances(vectors[rows]).argmin(1)]
            out[todo] = self.leaf[at[todo]]
            todo = todo[out[todo] < 0]
        return out

    def best_bins(self, distances: np.ndarray) -> Iterator[tuple[float, int]]:
        """(reach, leaf) in the order of the priority queue: the nearest open branch first.

        ``reach`` is the farthest centre on the way, the bound at which a search stops before this leaf.
        """
        queue = [(float(distances[n]), 0.0, n) for n in self.children.get(-1, [])]
        heapq.heapify(queue)
        while queue:
            distance, before, node = heapq.heappop(queue)
            reach = max(before, distance)
            if self.leaf[node] >= 0:
                yield reach, int(self.leaf[node])
            for child in self.children.get(node, []):
                heapq.heappush(queue, (float(distances[child]), reach, child))


def _cluster(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's k-means from spread-out starts: (centres, nearest centre of each point); empty clusters vanish."""
    nearest = ((points - points[rng.integers(len(points))]) ** 2).sum(1)
    starts = []
    for _ in range(k):
        if not nearest.sum() > 0:
            break
        starts.append(points[rng.choice(len(points), p=nearest / nearest.sum())])
        nearest = np.minimum(nearest, ((points - starts[-1]) ** 2).sum(1))
    centres = np.array(starts) if starts else points[:1]
    for _ in range(rounds):
        label = Tree(centres, np.full(len(centres), -1), np.arange(len(centres))).distances(points).argmin(1)
        used = np.unique(label)
        centres = np.array([points[label == c].mean(0) for c in used])
    return centres, Tree(centres, np.full(len(centres), -1), np.arange(len(centres))).distances(points).argmin(1)


def grow(points: np.ndarray, leaf_points: int = LEAF_SAMPLE, branches: int = BRANCHES, seed: int = 13) -> Tree:
    """The k-means tree of a sample of at least one point."""
    rng = np.random.default_rng(seed)
    centres, parents, leaf = [], [], []
    todo = [(-1, points)]
    n_leaves = 0
    while todo:
        parent, inside = todo.pop()
        k = min(branches, max(1, math.ceil(len(inside) / leaf_points)))
        means, label = _cluster(inside, k, rng)
        for c, mean in enumerate(means):
            own = inside[label == c]
            if not len(own):
                continue
            node = len(centres)
            centres.append(mean)
            parents.append(parent)
            # a part that did not shrink cannot be cut
            if len(own) > leaf_points and len(own) < len(inside):
                leaf.append(-1)
                todo.append((node, own))
            else:
                leaf.append(n_leaves)
                n_leaves += 1
    return Tree(np.array(centres), np.array(parents), np.array(leaf))


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    """A list column of doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def nearest_in_block(
    queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int, within: np.ndarray | None = None
) -> list[list[tuple[float, int]]]:
    """Per query the k nearest (distance, id) of a block, none farther than its entry in ``within``.

    Products give candidates within a rounding bound of the k-th; their distances are then taken exactly.
    """
    norms, out = (vectors**2).sum(1), []
    for q, limit in zip(queries, within if within is not None else np.full(len(queries), np.inf)):
        squares = norms - 2 * (vectors @ q) + q @ q
        bound = limit * limit
        if len(squares) > k:
            bound = min(bound, np.partition(squares, k - 1)[k - 1])
        near = np.flatnonzero(squares <= bound + 2 * ROUNDING * (norms.max() + q @ q))
        exact = np.sqrt(((vectors[near] - q) ** 2).sum(1))
        out.append(sorted((float(d), i) for d, at in zip(exact, near) if d <= limit for i in ids[at])[:k])
    return out


def _hash_key() -> list[Column]:
    return [F.xxhash64(F.lit(1), "vector").alias("ka"), F.xxhash64(F.lit(2), "vector").alias("kb")]


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector array<double>) of the rows that take part: one per id, all of the most frequent length."""
    fine = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull()
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    # 0.0 for -0.0, so that equal vectors have equal keys
    return fine.groupBy("id").agg(F.min(F.transform("vector", lambda x: x + F.lit(0.0))).alias("vector"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(ka, kb, vector, ids): every different vector of ``rows`` (id, vector) once, with its ``keep`` smallest ids."""
    keyed = rows.select("id", "vector", *_hash_key())
    # the limit is taken in every task first, so copies without end do not meet
    few = keyed.withColumn("at", F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))).where(F.col("at") <= keep)
    return few.groupBy(*KEY).agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


class Index:
    """All vectors of ``rows`` in the leaves of a tree fitted on at most ``sample`` of them."""

    def __init__(self, rows: DataFrame, id_column: str, vector: str, k: int = 10, sample: int = SAMPLE, leaf_sample: int = LEAF_SAMPLE):
        self.k, self.spark = k, rows.sparkSession
        all_rows = stage(usable(rows, id_column, vector), "vectors")
        lengths = all_rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.width = lengths[0].n if lengths else 0
        self.rows = all_rows.where(F.size("vector") == self.width)
        # k + 1 ids, as a query's own id may be among them
        distinct = stage(distinct_vectors(self.rows, k + 1), "distinct-vectors")
        self.tree = None
        total = distinct.count()
        if not total:
            return
        share = min(1.0, sample / total)
        drawn = distinct.where(F.pmod(F.xxhash64(F.lit(3), *KEY), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(2 * sample)
        points = _stacked(drawn.toArrow().column(0).combine_chunks(), self.width)
        if not len(points):
            points = _stacked(distinct.select("vector").limit(1).toArrow().column(0).combine_chunks(), self.width)
        self.tree = grow(points, leaf_sample)
        self.vectors = stage(self._assigned(distinct), "leaves")
        sizes = self.vectors.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("ids")).collect()
        self.leaf_rows = {r.leaf: r["rows"] for r in sizes}  # one entry per leaf of the bounded tree
        self.leaf_ids = {r.leaf: r["ids"] for r in sizes}

    def _assigned(self, distinct: DataFrame) -> DataFrame:
        tree, width = self.tree, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.assign(_stacked(batch.column(2), width)) if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])

        return distinct.mapInArrow(run, "ka long, kb long, vector array<double>, ids array<long>, leaf int")

    def _visits(self, queries: DataFrame, reach: float | None) -> DataFrame:
        """(ka, kb, vector, kth, leaf): the leaves each query visits first or, given ``reach``, the further ones.

        ``queries``: ka, kb, vector, kth; kth is the k-th distance found so far.  The first leaves go on until they hold k + 1 ids.
        """
        tree, width, leaf_ids, enough = self.tree, self.width, self.leaf_ids, self.k + 1

        def first(ranked: Iterator[tuple[float, int]]) -> Iterator[int]:
            ids = visited = 0
            for _, leaf in ranked:
                if leaf not in leaf_ids:
                    continue
                yield leaf
                ids, visited = ids + leaf_ids[leaf], visited + 1
                if visited >= FIRST_LEAVES and ids >= enough:
                    return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                distances = tree.distances(_stacked(batch.column(2), width))
                leaves = []
                for row, near in enumerate(distances):
                    ranked = list(first(tree.best_bins(near)))
                    if reach is not None:
                        bound, seen, ranked = reach * batch.column(3)[row].as_py(), set(ranked), []
                        for at, leaf in tree.best_bins(near):
                            if at > bound:
                                break
                            if leaf in leaf_ids and leaf not in seen:
                                ranked.append(leaf)
                    leaves.append(ranked)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["ka", "kb", "vector", "kth", "leaves"]
                )

        visited = queries.mapInArrow(run, "ka long, kb long, vector array<double>, kth double, leaves array<int>")
        return visited.select(*KEY, "vector", "kth", F.explode("leaves").alias("leaf"))

    def _search(self, visits: DataFrame) -> DataFrame:
        """(ka, kb, score, id): of every visited block the nearest ids of each query."""
        visits = stage(visits, "visits")
        askers = {r.leaf: r["count"] for r in visits.groupBy("leaf").count().collect()}
        blocks = [(leaf, math.ceil(self.leaf_rows[leaf] / BLOCK), math.ceil(n / BLOCK)) for leaf, n in askers.items()]
        dealt = F.broadcast(self.spark.createDataFrame(blocks, "leaf int, parts int, groups int"))  # one row per leaf
        part = F.pmod(F.xxhash64(*KEY), F.col("parts")).cast("int")
        group = F.pmod(F.xxhash64(*KEY), F.col("groups")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = self.vectors.join(dealt, "leaf").select("leaf", part.alias("part"), every("groups").alias("group"), "vector", "ids")
        asked = visits.join(dealt, "leaf").select("leaf", group.alias("group"), every("parts").alias("part"), *KEY, "vector", "kth")
        width, k = self.width, self.k + 1

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            found: list[list[tuple[float, int]]] = []
            if held.num_rows and asked.num_rows:
                vectors = _stacked(held.column("vector").combine_chunks(), width)
                queries = _stacked(asked.column("vector").combine_chunks(), width)
                # what is farther than the k-th hit so far is no result, so few rows leave a block
                found = nearest_in_block(queries, vectors, held.column("ids").to_pylist(), k, asked.column("kth").to_numpy())
            sizes = [len(f) for f in found]
            keys = [np.repeat(asked.column(c).to_numpy(), sizes) if found else np.zeros(0, np.int64) for c in KEY]
            hits = [hit for f in found for hit in f]
            score, ids = pa.array([d for d, _ in hits], pa.float64()), pa.array([i for _, i in hits], pa.int64())
            return pa.table({"ka": keys[0], "kb": keys[1], "score": score, "id": ids})

        by = ["leaf", "part", "group"]
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, "ka long, kb long, score double, id long")

    def _best(self, hits: DataFrame) -> DataFrame:
        """(ka, kb, hits): the k + 1 nearest of each query, nearest first, ties to the smaller id."""
        rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("score", "id"))
        few = hits.withColumn("at", rank).where(F.col("at") <= self.k + 1)
        return few.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("hits"))

    def _exact(self, queries: list[tuple[int, int, list[float]]]) -> DataFrame:
        """(ka, kb, score, id, leaf): the nearest ids of a bounded list of queries among all vectors."""
        keys = np.array([q[:2] for q in queries], np.int64)
        asked = np.array([q[2] for q in queries])
        width, k = self.width, self.k + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                leaves = dict(zip((i for ids in batch.column(1).to_pylist() for i in ids), np.repeat(batch.column(2).to_numpy(), [len(x) for x in batch.column(1).to_pylist()]).tolist()))
                found = nearest_in_block(asked, _stacked(batch.column(0), width), batch.column(1).to_pylist(), k)
                rows = [(keys[q, 0], keys[q, 1], d, i, leaves[i]) for q, f in enumerate(found) for d, i in f]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["ka", "kb", "score", "id", "leaf"])

        hits = self.vectors.select("vector", "ids", "leaf").mapInArrow(run, "ka long, kb long, score double, id long, leaf int")
        rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("score", "id"))
        return hits.withColumn("at", rank).where(F.col("at") <= k).drop("at")

    def calibrate(self, first: DataFrame, sample: int, recall: float) -> float:
        """The least reach that finds ``recall`` of the true neighbours of at most ``sample`` of the queries ``first`` (ka, kb, vector, kth)."""
        asked = [tuple(r) for r in first.orderBy(F.xxhash64(F.lit(4), *KEY), *KEY).limit(sample).select(*KEY, "vector", "kth").collect()]
        true: dict[tuple[int, int], list[int]] = {}
        for r in self._exact([q[:3] for q in asked]).collect():
            true.setdefault((r.ka, r.kb), []).append(r.leaf)
        ratios = []
        for ka, kb, vector, kth in asked:
            near = self.tree.distances(np.array([vector]))[0]
            ranked = dict((leaf, at) for at, leaf in self.tree.best_bins(near))
            visited, ids = set(), 0
            for _, leaf in self.tree.best_bins(near):
                if leaf in self.leaf_ids:
                    if len(visited) >= FIRST_LEAVES and ids >= self.k + 1:
                        break
                    visited.add(leaf)
                    ids += self.leaf_ids[leaf]
            for leaf in true[ka, kb]:
                ratios.append(0.0 if leaf in visited else ranked[leaf] / kth if kth > 0 else math.inf)
        ratios.sort()
        reach = ratios[min(len(ratios) - 1, math.ceil(recall * len(ratios)) - 1)] if ratios else 0.0
        # a little wider, so that rounding does not leave the last leaf out
        return reach * (1 + 1e-9) if reach < math.inf else max([r for r in ratios if r < math.inf], default=0.0)

    def neighbours(self, is_query: Column | str, sample: int = CALIBRATION, recall: float = RECALL) -> DataFrame:
        """(query_id, rank, vec_id, score) of the rows whose ``id`` fulfils ``is_query``."""
        schema = "query_id long, rank int, vec_id long, score double"
        if self.tree is None:
            return self.spark.createDataFrame([], schema)
        rows = self.rows.where(is_query).select("id", "vector", *_hash_key())
        queries = stage(rows.groupBy(*KEY).agg(F.first("vector").alias("vector")), "queries")
        if queries.isEmpty():
            return self.spark.createDataFrame([], schema)
        unknown = queries.withColumn("kth", F.lit(math.inf))
        start = stage(self._best(self._search(self._visits(unknown, None))), "first-hits")
        kth = start.select(*KEY, F.element_at("hits", -1)["score"].alias("kth"))
        first = stage(queries.join(kth, KEY).select(*KEY, "vector", "kth"), "first-distances")
        self.reach = self.calibrate(first, sample, recall)
        wider = self._visits(first, self.reach)
        further = self._search(wider)
        both = start.select(*KEY, F.inline("hits")).unionByName(further)
        best = stage(self._best(both), "hits")
        # a hot vector may be asked by many ids; merged, so that its rows can be split
        named = rows.select("id", *KEY).join(best.hint("merge"), KEY)
        others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, self.k)
        listed = named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
        return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def search(
    rows: DataFrame,
    is_query: Column | str,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    sample: int = SAMPLE,
    leaf_sample: int = LEAF_SAMPLE,
    calibration: int = CALIBRATION,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row whose ``id`` fulfils ``is_query``, its own left out.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id.  Vectors that
    are NULL, empty, zero or hold NULL or non-finite components, and rows without id, take no part; nor do vectors of another
    length than the most frequent one.  Of several rows with one id the one with the least vector counts.  With fewer than k others all
    are returned; an empty table gives no rows.  The tree is fitted on about ``sample`` vectors (twice at most) and the reach on ``calibration``
    queries, both chosen by hash; all rows are indexed and searched.
    """
    return Index(rows, id_column, vector, k, sample, leaf_sample).neighbours(is_query, calibration, recall)
