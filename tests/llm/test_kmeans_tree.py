import math

import numpy as np
import pytest
from conftest import SF

from paperloom.llm import kmeans_tree

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, ka int, leaf int, ids int"
IS_QUERY = "id % 10 = 0"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", 1, 1, 1) for i, v in rows], SCHEMA)


def brute(rows, every=10, k=10):
    kept = [(i, np.float32(v).astype(float)) for i, v in rows]
    out = {}
    for i, v in kept:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in kept if j != i)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12))
    data = np.concatenate([centres[rng.integers(30, size=2500)] + rng.normal(scale=0.2, size=(2500, 12)), rng.normal(size=(300, 12))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    want = brute(rows)
    got = found(kmeans_tree.search(table(spark, rows), IS_QUERY, leaf_sample=20))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    vectors = {i: np.float32(v).astype(float) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near) and q not in [i for _, i in near]
        assert all(s == pytest.approx(math.dist(vectors[q], vectors[i]), abs=1e-12) for s, i in near)


def test_copies_in_blocks(spark, monkeypatch):
    """A vector that a third of all rows share, and blocks smaller than a leaf: everything is found."""
    monkeypatch.setattr(kmeans_tree, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, -0.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    got = found(kmeans_tree.search(table(spark, rows), IS_QUERY, leaf_sample=16, recall=1.0, calibration=400))
    want = brute(rows)
    assert {q: [i for _, i in h] for q, h in got.items()} == {q: [i for _, i in h] for q, h in want.items()}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (10, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None)]
    rows += [(6, []), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [4.0, 4.0]), (20, [nan, nan])]
    got = found(kmeans_tree.search(table(spark, rows), IS_QUERY))
    assert got == {0: [(0.0, 10), (5.0, 8)], 10: [(0.0, 0), (5.0, 8)]}
    assert kmeans_tree.search(table(spark, []), IS_QUERY).count() == 0
    assert kmeans_tree.search(table(spark, [(10, [1.0])]), IS_QUERY).count() == 0
    assert kmeans_tree.search(table(spark, [(11, [1.0])]), IS_QUERY).count() == 0


def test_tree_reaches_every_leaf_once():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(900, 4))
    tree = kmeans_tree.grow(points, leaf_points=10, branches=4)
    order = list(tree.best_bins(tree.distances(points[:1])[0]))
    assert sorted(leaf for _, leaf in order) == list(range(tree.leaves)) and tree.leaves > 50
    assert set(tree.assign(points)) <= set(range(tree.leaves))
    assert kmeans_tree.grow(np.ones((500, 3)), leaf_points=10).leaves == 1


def test_recall_on_the_embeddings(spark):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    got = found(kmeans_tree.search(rows, "id % 100 = 0"))
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], every=100)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
