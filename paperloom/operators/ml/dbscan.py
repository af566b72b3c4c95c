"""Exact density clustering on a grid, without listing neighbour pairs of dense regions.

Space is cut into cells whose diagonal is at most ``eps``, so points of one cell are
all neighbours.  A cell with ``min_samples`` points (a dense cell) has only core
points, known without measuring a distance.  What is left to measure:

* points of sparse cells against nearby cells.  A sparse cell has fewer than
  ``min_samples`` points, so a point meets a bounded number of them, whatever
  the density, and the work is linear;
* whether two dense cells touch.  Their bounding boxes decide most pairs; the
  undecided ones are cut into sub-cells until a pair of points is found or ruled out.

Clusters are the connected components of the cell graph.  A cell with very many
points is split into parts, so that joins by cell spread it over several tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.blocks import meet_in_blocks
from paperloom.plans.joins import lookup_join
from paperloom.plans.materialize import materialize
from paperloom.plans.number import number_rows

# --- fixed values: must equal the expected output ---------------------------------
EPS = 0.5
MIN_SAMPLES = 5
NOISE = -1
# -----------------------------------------------------------------------------------

CELL_PART = 100_000  # distinct points of one cell that a join may bring into one task
SMALL_GRAPH = 100_000  # edges that one task may hold
GRID_DIMENSIONS = 3  # up to here neighbour cells are enumerated, beyond it cells meet in blocks
_SAFETY = 1.0 - 1e-9  # keeps rounding from putting points farther apart than eps into one cell


def _d2(a: str, b: str, dims: range) -> Column:
    """Squared distance of ``a.x{i}`` and ``b.x{i}``."""
    total = F.lit(0.0)
    for i in dims:
        gap = F.col(f"{a}.x{i}") - F.col(f"{b}.x{i}")
        total = total + gap * gap
    return total


def _box_d2(a: str, b: str, dims: range, farthest: bool) -> Column:
    """Smallest or largest squared distance between the boxes ``a`` and ``b``."""
    total = F.lit(0.0)
    for i in dims:
        one = F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}")
        two = F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}")
        gap = F.greatest(F.abs(one), F.abs(two)) if farthest else F.greatest(one, two, F.lit(0.0))
        total = total + gap * gap
    return total


def _boxes(points: DataFrame, keys: Sequence[str], dims: range) -> DataFrame:
    sample = F.min_by(F.struct(*[f"x{i}" for i in dims]), "uid")
    return points.groupBy(*keys).agg(
        F.sum("w").alias("n"),
        F.count("*").alias("places"),
        *[F.min(f"x{i}").alias(f"lo{i}") for i in dims],
        *[F.max(f"x{i}").alias(f"hi{i}") for i in dims],
        sample.alias("sample"),
    )


def _hot_cells(cells: DataFrame, part_rows: int) -> DataFrame:
    """(cell, parts) of the cells over ``part_rows`` points: at most one row per ``part_rows`` points of the table."""
    parts = F.ceil(F.col("places") / part_rows).cast("int")
    return cells.where(F.col("places") > part_rows).select("cell", parts.alias("parts"))


def _put_in_parts(points: DataFrame, hot: DataFrame) -> DataFrame:
    """Add ``part``: which part of its cell a point belongs to."""
    joined = points.join(F.broadcast(hot), "cell", "left")
    part = F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)).cast("int")
    return joined.withColumn("part", part).drop("parts")


def _for_parts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Repeat rows addressed to a ``cell`` for each of its parts."""
    joined = rows.join(F.broadcast(hot), "cell", "left")
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return joined.withColumn("part", F.explode(parts)).drop("parts")


def _near_cells(cells: DataFrame, dims: range, eps: float) -> DataFrame:
    """(a, b): ordered pairs of different cells whose boxes come within ``eps``."""
    table = cells.select("cell", *[f"lo{i}" for i in dims], *[f"hi{i}" for i in dims])
    if len(dims) <= GRID_DIMENSIONS:
        reach = int(math.floor(1 + math.sqrt(len(dims)) / _SAFETY**2))
        steps = [
            s
            for s in itertools.product(range(-reach, reach + 1), repeat=len(dims))
            if any(s) and sum(max(abs(o) - 1, 0) ** 2 for o in s) <= len(dims) / _SAFETY**4
        ]
        shifts = F.array(*[F.array(*[F.lit(o).cast("long") for o in s]) for s in steps])
        moved = F.transform(shifts, lambda s: F.zip_with(F.col("cell"), s, lambda c, o: c + o))
        wanted = table.select("*", F.explode(moved).alias("other"))
        pairs = wanted.alias("a").join(table.alias("b"), F.col("a.other") == F.col("b.cell"))
        return pairs.where(_box_d2("a", "b", dims, False) <= eps * eps).select(
            F.col("a.cell").alias("a"), F.col("b.cell").alias("b")
        )

    lows, highs = [f"lo{i}" for i in dims], [f"hi{i}" for i in dims]
    keyed = table.withColumn("key", F.concat_ws(",", "cell")).drop("cell")

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        lo, hi = right[lows].to_numpy(), right[highs].to_numpy()
        names = right["key"].to_numpy()
        for key, a_lo, a_hi in zip(left["key"], left[lows].to_numpy(), left[highs].to_numpy()):
            gap = np.maximum(np.maximum(a_lo - hi, lo - a_hi), 0.0)
            close = ((gap**2).sum(axis=1) <= eps * eps) & (names != key)
            found.append(pd.DataFrame({"a": key, "b": names[close]}))
        return pd.concat(found)

    found = meet_in_blocks(keyed, keyed, "key", "key", near, "a string, b string")
    back = lambda c: F.split(c, ",").cast("array<long>")
    return found.select(back("a").alias("a"), back("b").alias("b"))


def _touching_dense(
    points: DataFrame, cells: DataFrame, near: DataFrame, hot: DataFrame, dims: range, eps: float, side: float
) -> DataFrame:
    """(a, b) for dense cells that hold a pair of points within ``eps``."""
    limit = eps * eps
    dense = cells.select("cell")
    pairs = near.where(F.col("a") < F.col("b"))
    pairs = pairs.join(dense.withColumnRenamed("cell", "a"), "a", "left_semi")
    pairs = pairs.join(dense.withColumnRenamed("cell", "b"), "b", "left_semi")
    fields = ["sample", *[f"lo{i}" for i in dims], *[f"hi{i}" for i in dims]]
    box = F.struct(*fields)
    sides = cells.select("cell", box.alias("box"))
    open_pairs = pairs.join(sides.select(F.col("cell").alias("a"), F.col("box").alias("p")), "a").join(
        sides.select(F.col("cell").alias("b"), F.col("box").alias("q")), "b"
    )
    touching = None
    level = 0
    while True:
        judged = open_pairs.select(
            "*",
            ((_d2("p.sample", "q.sample", dims) <= limit) | (_box_d2("p", "q", dims, True) <= limit)).alias("touch"),
            (_box_d2("p", "q", dims, False) <= limit).alias("possible"),
        )
        judged = materialize(judged.where("touch or possible"), "dense-pairs")
        found = judged.where("touch").select("a", "b").distinct()
        touching = found if touching is None else touching.unionByName(found)
        left = judged.where("not touch").join(found, ["a", "b"], "left_anti").select("a", "b", "p", "q")
        if not left.take(1):
            return touching
        level += 1
        width = side / 2**level
        involved = left.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        finer = points.join(_for_parts(involved, hot), ["cell", "part"], "left_semi").withColumn(
            "sub", F.array(*[F.floor(F.col(f"x{i}") / width) for i in dims])
        )
        if level > 60:  # below the spacing of doubles: single points
            finer = finer.withColumn("sub", F.array("uid"))
        boxes = materialize(_boxes(finer, ["cell", "sub"], dims).select("cell", box.alias("box")), "sub-cells")
        todo = left.select("a", "b").distinct()
        open_pairs = todo.join(boxes.select(F.col("cell").alias("a"), F.col("box").alias("p")), "a").join(
            boxes.select(F.col("cell").alias("b"), F.col("box").alias("q")), "b"
        )
        # only sub-cells that can still be in reach of the other cell's box go on
        open_pairs = open_pairs.where(_box_d2("p", "q", dims, False) <= limit)


def _join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union by smaller id over a bounded edge list."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["src"].tolist(), batch["dst"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"src": list(parent), "root": [root(x) for x in list(parent)]}, dtype="int64")


def connected_components(nodes: DataFrame, edges: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """(node, component): the smallest node id reachable.

    ``nodes``: node.  ``edges``: src, dst.  Every round hooks each component to its
    smallest neighbour, shortens the hooks to their roots by doubling, and contracts
    the edges to the roots, so the graph shrinks fast and long chains cost a
    logarithmic number of steps.  Each round is written.  Once at most
    ``small_graph`` edges are left (counted), one task finishes them.
    """
    labels = nodes.select("node", F.col("node").alias("component"))
    live = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    while (left := live.count()) > 0:
        if left <= small_graph:
            hooks = live.coalesce(1).mapInPandas(_join_up, "src long, root long")
            return labels.join(hooks.withColumnRenamed("src", "component"), "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            )
        ends = live.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
        hooks = ends.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("root"))
        hooks = materialize(hooks, "hooks")
        while True:
            upper = hooks.select(F.col("src").alias("root"), F.col("root").alias("next"))
            further = hooks.join(upper, "root", "left").select(
                "src", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")
            )
            further = materialize(further, "hooks")
            hooks = further.select("src", "root")
            if not further.where("moved").take(1):
                break
        labels = labels.join(hooks.withColumnRenamed("src", "component"), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")
        )
        labels = materialize(labels, "components")
        live = live.join(hooks.select("src", F.col("root").alias("a")), "src").join(
            hooks.select(F.col("src").alias("dst"), F.col("root").alias("b")), "dst"
        )
        live = live.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        live = materialize(live, "edges")
    return labels


def dbscan(
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
    cell_part: int = CELL_PART,
) -> DataFrame:
    """``(id, cluster)``: -1 for noise; clusters numbered from 0 by their smallest core id.

    ``id_col`` must be numeric and unique: it stands for the row order.  A border
    point takes the lowest cluster among its core neighbours.  A row with a NULL
    coordinate is near nothing: noise.
    """
    dims = range(len(columns))
    side = eps / math.sqrt(len(columns)) * _SAFETY
    limit = eps * eps
    raw = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    xs = [f"x{i}" for i in dims]
    raw = raw.select("id", *[(F.col(x) + F.lit(0.0)).alias(x) for x in xs])  # -0.0 and 0.0 are one place
    places = raw.dropna(subset=xs).groupBy(*xs).agg(F.min("id").alias("uid"), F.count("*").alias("w"))
    cell = F.array(*[F.floor(F.col(x) / side) for x in xs])
    points = materialize(places.withColumn("cell", cell), "places")
    cells = materialize(_boxes(points, ["cell"], dims), "cells")
    hot = materialize(_hot_cells(cells, cell_part), "hot-cells")
    points = _put_in_parts(points, hot)
    here = ["cell", "part"]
    dense = cells.where(F.col("n") >= min_samples)
    near = materialize(_near_cells(cells, dims, eps), "near")

    # sparse points: few per cell, so each point of a neighbour cell meets a bounded number of them
    sparse_cells = cells.where(F.col("n") < min_samples).select("cell", F.col("n").alias("own"))
    sparse = materialize(points.join(_for_parts(sparse_cells, hot), here).drop("part"), "sparse")
    meet = sparse.alias("s").join(near.alias("g"), F.col("s.cell") == F.col("g.a")).select(
        F.col("s.uid").alias("uid"), F.struct(*[F.col(f"s.{x}") for x in xs]).alias("s"), F.col("g.b").alias("cell")
    )
    # joins that carry points are never broadcast: their files are small, their rows are not
    close = _for_parts(meet, hot).join(points.select(*here, "w", F.struct(*xs).alias("t")).hint("merge"), here).where(
        _d2("s", "t", dims) <= limit
    )
    counted = close.groupBy("uid").agg(F.sum("w").alias("seen"))
    sparse = materialize(
        sparse.join(counted, "uid", "left").withColumn(
            "core", (F.col("own") + F.coalesce("seen", F.lit(0))) >= min_samples
        ),
        "sparse-core",
    )
    sparse_core = sparse.where("core")
    in_dense = points.join(_for_parts(dense.select("cell"), hot), here, "left_semi")
    core = in_dense.select("uid", *here, *xs).unionByName(
        sparse_core.withColumn("part", F.lit(0)).select("uid", *here, *xs)
    )
    core = materialize(core, "core")

    # cell graph: the core points of a cell are one node, named by their smallest id
    named = materialize(core.groupBy("cell").agg(F.min("uid").alias("node")), "core-cells")
    from_sparse = sparse_core.alias("s").join(near.alias("g"), F.col("s.cell") == F.col("g.a")).select(
        F.col("s.cell").alias("a"), F.struct(*[F.col(f"s.{x}") for x in xs]).alias("s"), F.col("g.b").alias("cell")
    )
    sparse_edges = (
        _for_parts(from_sparse, hot)
        .join(core.select(*here, F.struct(*xs).alias("t")).hint("merge"), here)
        .where(_d2("s", "t", dims) <= limit)
        .select("a", F.col("cell").alias("b"))
        .distinct()
    )
    edges = sparse_edges.unionByName(_touching_dense(points, dense, near, hot, dims, eps, side))
    edges = edges.join(named.select(F.col("cell").alias("a"), F.col("node").alias("src")), "a").join(
        named.select(F.col("cell").alias("b"), F.col("node").alias("dst")), "b"
    )
    components = connected_components(named.select("node"), edges)
    components = materialize(named.join(components, "node").select("cell", "component"), "clusters")

    # border points lie in sparse cells only
    border = sparse.where(~F.col("core")).alias("s").join(near.alias("g"), F.col("s.cell") == F.col("g.a"))
    border = border.select(F.col("s.uid").alias("uid"), F.struct(*[F.col(f"s.{x}") for x in xs]).alias("s"), F.col("g.b").alias("cell"))
    reached = (
        _for_parts(border, hot)
        .join(core.select(*here, F.struct(*xs).alias("t")).hint("merge"), here)
        .where(_d2("s", "t", dims) <= limit)
        .select("uid", "cell")
        .distinct()
        .join(components, "cell")
    )
    own = sparse.where(~F.col("core")).select("uid", "cell").join(
        core.select("cell").distinct(), "cell", "left_semi"
    ).join(components, "cell")
    border_label = reached.select("uid", "component").unionByName(own.select("uid", "component")).groupBy("uid").agg(
        F.min("component").alias("component")
    )
    core_label = core.join(_for_parts(components, hot), here).select("uid", "component")
    labels = core_label.unionByName(border_label)

    numbered = number_rows(components.select("component").distinct().orderBy("component"), "cluster")
    labels = lookup_join(labels, materialize(numbered, "numbers"), ["component"])
    place_labels = points.select("uid", *xs).join(labels.select("uid", "cluster").hint("merge"), "uid", "left")
    place_labels = materialize(place_labels.select(*xs, F.coalesce("cluster", F.lit(NOISE)).alias("cluster")), "labels")
    labelled = lookup_join(raw, place_labels, xs, "left")
    return labelled.select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))

