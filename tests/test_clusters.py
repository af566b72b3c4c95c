"""Clustering, components and anomalies against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators.ml.anomaly import anomaly_counts, grow_trees, isolation_forest, tree_samples
from paperloom.operators.ml.cluster import kmeans, pca
from paperloom.operators.ml.dbscan import connected_components, dbscan
from paperloom.operators.ml.metrics import (
    MOSTLY_NOISE,
    ONE_CLUSTER,
    calinski_harabasz,
    clustering_metrics,
    davies_bouldin,
    silhouette,
    silhouette_squared,
)


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    labels, cluster = -np.ones(len(x), int), 0
    for i in range(len(x)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            if labels[p] == -1:
                labels[p] = cluster
                if core[p]:
                    stack += [q for q in np.flatnonzero(near[p]) if labels[q] == -1]
        cluster += 1
    return labels


def points(dims, n, scale, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, scale, (n // 2, dims)), rng.normal(3, 0.3, (n // 4, dims)), rng.uniform(-6, 6, (n // 4, dims))])
    x = np.concatenate([x, np.repeat(x[:3], 8, axis=0)])  # copies
    rng.shuffle(x)
    return x


@pytest.mark.parametrize("dims,n,scale,least", [(1, 120, 8.0, 5), (2, 240, 0.4, 4), (3, 160, 1.0, 5), (5, 120, 0.4, 5)])
def test_dbscan_equals_brute_force(spark, dims, n, scale, least):
    x = points(dims, n, scale, dims)
    columns = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns).assign(id=np.arange(len(x))))
    # small parts, so that the split of hot cells is exercised
    got = dbscan(df, "id", columns, min_samples=least, cell_part=4).toPandas().sort_values("id")["cluster"].to_numpy()
    want = brute_dbscan(x, 0.5, least)
    assert len(set(want)) > 2 and (got == want).all()


def test_dbscan_separates_touching_dense_cells_exactly(spark):
    # two dense lines whose gap is just above or just below eps
    for gap, clusters in ((0.5000001, 2), (0.4999999, 1)):
        x = np.concatenate([-np.linspace(0, 0.3, 200), gap + np.linspace(0, 0.3, 200)])
        df = spark.createDataFrame(pd.DataFrame({"x": x, "id": np.arange(400)}))
        assert dbscan(df, "id", ["x"]).select("cluster").distinct().count() == clusters


def test_dbscan_all_noise(spark):
    df = spark.createDataFrame([(i, float(10 * i)) for i in range(6)], "id long, x double")
    assert {r.cluster for r in dbscan(df, "id", ["x"]).collect()} == {-1}


@pytest.mark.parametrize("small_graph", [0, 10**6])
def test_components(spark, small_graph):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(40)]
    noise = [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    parent = {v: v for v in [*range(41), *range(100, 160)]}
    changed = True
    while changed:
        changed = False
        for a, b in chain + noise:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    nodes = spark.createDataFrame([(v,) for v in parent], "node long")
    edges = spark.createDataFrame(chain + noise, "src long, dst long")
    got = {r.node: r.component for r in connected_components(nodes, edges, small_graph).collect()}
    assert got == parent


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.6, (40, 3)) for c in (0, 2, 5)] + [[[9.0, 9.0, 9.0]]])
    return x, np.array([0] * 40 + [1] * 40 + [2] * 40 + [3])


@pytest.fixture(scope="module")
def clustered(spark, blobs):
    rows = [(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(*blobs))]
    return spark.createDataFrame(rows, "id long, features array<double>, cluster int").cache()


def value(df):
    return df.first().value


def test_cluster_indices(clustered, blobs):
    x, k = blobs
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        mine = k == k[i]
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, k == o].mean() for o in set(k) - {k[i]})
        scores.append((b - a) / max(a, b))
    assert value(silhouette(clustered, "id")) == pytest.approx(np.mean(scores))
    assert value(silhouette(clustered, "id", max_broadcast_rows=1, rows_per_block=25)) == pytest.approx(np.mean(scores))
    centers = np.array([x[k == c].mean(0) for c in range(4)])
    spread = np.array([np.sqrt(((x[k == c] - centers[c]) ** 2).sum(1)).mean() for c in range(4)])
    ratio = [max((spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in range(4) if j != i) for i in range(4)]
    assert value(davies_bouldin(clustered)) == pytest.approx(np.mean(ratio))
    between = sum((k == c).sum() * ((centers[c] - x.mean(0)) ** 2).sum() for c in range(4))
    within = sum(((x[k == c] - centers[c]) ** 2).sum() for c in range(4))
    assert value(calinski_harabasz(clustered)) == pytest.approx((between / 3) / (within / (len(x) - 4)))
    assert 0 < value(silhouette_squared(clustered)) < 1


def test_one_cluster_gives_a_warning(clustered):
    one = clustered.withColumn("cluster", F.lit(0))
    assert [(r.metric, r.label) for r in clustering_metrics(one, "id").collect()] == [("warning", ONE_CLUSTER)]
    noise = clustered.withColumn("cluster", F.lit(-1))
    assert clustering_metrics(noise, "id", noise=-1).first().label == MOSTLY_NOISE
    assert {r.metric for r in clustering_metrics(clustered, "id", exact_silhouette=True).collect()} == {
        "silhouette_score", "davies_bouldin_index", "calinski_harabasz_index",
    }


def test_kmeans_finds_the_blobs(spark, blobs):
    x, k = blobs
    df = spark.createDataFrame(pd.DataFrame(x[:120], columns=list("abc")))
    labelled = kmeans(df, ["a", "b", "c"])[0].toPandas()["cluster"].to_numpy()
    assert all(len(set(labelled[k[:120] == c])) == 1 for c in range(3)) and len(set(labelled)) == 3


@pytest.mark.parametrize("scale", [True, False])
def test_pca_equals_svd(spark, blobs, scale):
    x, _ = blobs
    df = spark.createDataFrame(pd.DataFrame(x * [1, 5, 2], columns=list("abc")))
    coordinates, ratios, _ = pca(df, ["a", "b", "c"], scale=scale)
    y = x * [1, 5, 2]
    y = (y - y.mean(0)) / (y.std(0) if scale else 1)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    assert np.allclose([r.explained_variance_ratio for r in ratios.orderBy("component").collect()], (s**2 / (s**2).sum())[:2])
    got = np.array([r.coordinates for r in coordinates.collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    assert pca(df, ["a", "b"], components=9)[1].count() == 2


def test_tree_samples_are_exact_and_repeatable(spark, partitions):
    df = spark.range(3000).select("id", F.col("id").cast("double").alias("x"))
    seen = []
    for n in (1, 8):
        partitions(n)
        rows = tree_samples(df.repartition(n), "id", ["x"], 7, 64, 1).toPandas()
        assert (rows.groupby("tree").size() == 64).all() and rows["tree"].nunique() == 7
        assert not rows.duplicated(["tree", "_id"]).any()
        seen.append(set(map(tuple, rows[["tree", "_id"]].to_numpy())))
    assert seen[0] == seen[1]
    small = tree_samples(df.limit(10), "id", ["x"], 3, 64, 1)
    assert small.count() == 30


def test_trees_are_binary_and_bounded(spark):
    rng = np.random.default_rng(4)
    rows = [(t, i, float(v)) for t in range(3) for i, v in enumerate(rng.normal(size=64))]
    df = spark.createDataFrame(rows, "tree int, _id long, x double")
    nodes = grow_trees(df, ["x"], 64, 1).toPandas()
    for _, tree in nodes.groupby("tree"):
        inner = tree[tree.feature >= 0]
        assert len(tree) == 2 * len(inner) + 1
        assert sorted([*inner.left_node, *inner.right_node]) == sorted(tree.node[tree.node > 0])


def test_forest_flags_the_far_points(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(380, 2)), rng.uniform(8, 12, (20, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(400)))
    rows = isolation_forest(df, "id", ["a", "b"]).toPandas()
    flagged = set(rows.id[rows.label == "Anomaly"])
    assert len(flagged) == 20 and len(flagged & set(range(380, 400))) >= 17
    threshold = np.quantile(rows.score, 0.95)
    assert ((rows.score > threshold) == (rows.label == "Anomaly")).all()
    counts = anomaly_counts(spark.createDataFrame(rows)).first()
    assert (counts.anomaly_count, counts.normal_count) == (20, 380)


def test_null_coordinates_are_noise(spark):
    rows = [(i, 0.0, 0.1 * (i % 3)) for i in range(10)] + [(10, None, 1.0), (11, None, None)]
    got = dict(dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], eps=0.5, min_samples=3).collect())
    assert got == {**{i: 0 for i in range(10)}, 10: -1, 11: -1}
