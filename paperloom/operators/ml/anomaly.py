"""Isolation forest (Liu, Ting, Zhou, ICDM 2008)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.ml.prep import SEED, standardize
from paperloom.plans.materialize import materialize
from paperloom.plans.orderstats import quantiles
from paperloom.plans.project import spread

# --- fixed values: must equal the expected output ---------------------------------
CONTAMINATION = 0.05
TREES = 100
SAMPLE = 256
ANOMALY, NORMAL = "Anomaly", "Normal"
# -----------------------------------------------------------------------------------

_NODE = "tree int, node int, feature int, threshold double, left_node int, right_node int, depth_plus double"


def _path_credit(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def tree_samples(df: DataFrame, id_col: str, columns: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` rows per tree without replacement: those with the smallest hash of (id, tree).

    Only rows whose hash falls under a bound that passes a few times the wanted
    number are exploded, so the shuffle carries about ``trees * 4 * sample`` rows
    whatever the table size.
    """
    n = df.count()
    wanted = min(sample, n)

    def draws(times: int) -> DataFrame:
        share = min(1.0, times * wanted / max(n, 1))
        bound = F.lit(int(share * 2**63) - 1)

        def rank_of(tree: Column) -> Column:
            return F.xxhash64(F.col(id_col), tree, F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))

        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: rank_of(t) <= bound)
        rows = df.select(id_col, *columns, F.explode(chosen).alias("tree"))
        return rows.select(F.col(id_col).alias("_id"), *columns, "tree", rank_of(F.col("tree")).alias("h"))

    drawn = draws(4)
    if 4 * wanted < n:
        # every tree must find its full sample under the bound; draw without one otherwise (very unlikely)
        short = drawn.groupBy("tree").count().where(F.col("count") >= wanted).count() < trees
        drawn = draws(n) if short else drawn
    order = Window.partitionBy("tree").orderBy("h", "_id")
    return drawn.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= wanted).drop("_rn", "h")


def grow_trees(samples: DataFrame, columns: Sequence[str], sample: int, seed: int) -> DataFrame:
    """Node table of all trees; each group holds one tree's sample, at most ``sample`` rows."""
    columns = list(columns)
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        rows = rows.sort_values("_id")
        x = rows[columns].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        pending = [(np.arange(len(x)), 0, None, 0)]
        while pending:
            members, depth, parent, side = pending.pop()
            at = len(nodes)
            if parent is not None:
                nodes[parent][4 + side] = at
            low, high = x[members].min(axis=0), x[members].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or not len(usable):
                nodes.append([tree, at, -1, 0.0, -1, -1, depth + _path_credit(len(members))])
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            goes_left = x[members, feature] <= cut
            nodes.append([tree, at, feature, cut, -1, -1, 0.0])
            pending.append((members[~goes_left], depth + 1, at, 1))
            pending.append((members[goes_left], depth + 1, at, 0))
        return pd.DataFrame(nodes, columns=[f.split(" ")[0] for f in _NODE.split(", ")])

    return samples.groupBy("tree").applyInPandas(grow, _NODE)


def anomaly_scores(df: DataFrame, columns: Sequence[str], nodes: pd.DataFrame, sample: int) -> Column:
    """``2 ** (-mean path / credit(sample))`` per row.

    ``nodes`` is bounded by ``trees * (2 * sample - 1)`` rows and ships with the function.
    """
    forest = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(tree[c].to_numpy() for c in ("feature", "threshold", "left_node", "right_node", "depth_plus")))
    norm = _path_credit(sample) or 1.0

    def score(*features: pa.Array) -> pa.Array:
        x = np.column_stack([f.to_numpy(zero_copy_only=False).astype(np.float64) for f in features])
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, threshold, left, right, depth in forest:
            at = np.zeros(len(x), dtype=np.int64)
            active = every[feature[at] >= 0]
            while len(active):
                here = at[active]
                f = feature[here]
                at[active] = np.where(x[active, f] <= threshold[here], left[here], right[here])
                active = active[feature[at[active]] >= 0]
            total += depth[at]
        return pa.array(np.power(2.0, -total / (len(forest) * norm)))

    return F.arrow_udf(score, "double")(*[F.col(c).cast("double") for c in columns])


def isolation_forest(
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    contamination: float = CONTAMINATION,
    scale: bool = True,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with ``score`` and ``label``: Anomaly above the exact ``1 - contamination`` quantile of the scores."""
    columns = list(columns)
    work = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns])
    work = standardize(work, columns) if scale else work
    work = spread(materialize(work, "forest-input"))
    size = min(sample, work.count())
    nodes = grow_trees(tree_samples(work, id_col, columns, trees, sample, seed), columns, size, seed).toPandas()
    scored = work.select(id_col, anomaly_scores(work, columns, nodes, size).alias("score"))
    scored = materialize(scored, "scores")
    cut = quantiles(scored, [], "score", {"q": 1.0 - contamination}).select("q").scalar()
    label = F.when(F.col("score") > cut, ANOMALY).otherwise(NORMAL)
    return scored.withColumn("label", label)


def anomaly_counts(labelled: DataFrame) -> DataFrame:
    """One row ``(anomaly_count, normal_count)``."""
    return labelled.agg(
        F.count_if(F.col("label") == ANOMALY).alias("anomaly_count"),
        F.count_if(F.col("label") == NORMAL).alias("normal_count"),
    )
