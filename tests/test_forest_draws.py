"""Forests of tables with few places: only sums of draws are shuffled, stages go when they are done, trees are shipped small."""

import math
import os
import pickle

import numpy as np
import pyspark
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paperloom.operators.ml import trees as T
from paperloom.operators.ml.supervised import fit_supervised
from paperloom.plans import materialize as M
from paperloom.plans.materialize import materialize

RNG = np.random.default_rng(11)
N = 4000
X = np.column_stack([RNG.integers(6, size=N), RNG.integers(3, size=N)]).astype(float)
CLASS = (X[:, 0] + RNG.integers(2, size=N)).astype(int) % 3
LABEL = X[:, 0] * 2 + RNG.normal(size=N)


@pytest.fixture(scope="module")
def rows(spark):
    values = [(list(map(float, x)), float(y), int(k), i % 3, i) for i, (x, y, k) in enumerate(zip(X, LABEL, CLASS))]
    df = spark.createDataFrame(values, "f array<double>, number double, class int, fold int, row long")
    return materialize(df.withColumn("features", array_to_vector("f")).repartition(4))


@pytest.mark.parametrize("module,label", [("regression", "number"), ("classification", "class")])
def test_rows_are_not_shuffled(rows, monkeypatch, module, label):
    table = T.tree_table(rows.select("features", F.col(label).cast("double").alias("label"), "fold", "row"), module, 3)
    sent, deal = [], pyspark.RDD.partitionBy

    def noted(self, *args, **more):
        sent.append(self.map(lambda item: len(pickle.dumps(item))).sum())
        return deal(self, *args, **more)

    monkeypatch.setattr(pyspark.RDD, "partitionBy", noted)
    made = T.forest(table.chunks, table.bins, [-1], 24, 4, table.classes, 0.0, table.largest, table.rows, 0, 100)
    assert len(made) == 24 and sum(sent) < 8 * N * 24 / 4  # a number for each row and tree takes four times that


def test_draws_equal_their_definition():
    edges = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    near = [max(0, int(t) + d) for t in T._DRAWN_FROM for d in (-2049, -1025, -1, 0, 1, 1024, 4096)]
    hashes = np.concatenate([np.array([*near, 0, 2**64 - 1], np.uint64), RNG.integers(2**64, size=100_000, dtype=np.uint64)])
    assert np.array_equal(T._drawn(hashes), np.searchsorted(edges, hashes / 2.0**64, side="right"))


@pytest.mark.parametrize("numbers", [False, True])
def test_sums_of_draws(numbers):
    cell, row, label = RNG.integers(50, size=N) * 3, RNG.integers(-(2**62), 2**62, size=N), np.rint(LABEL * 64) / 64
    drawn, trees = T.Draws.of(cell.astype(np.int32), row, label if numbers else None), np.array([0, 5, 17])
    count, total = drawn.sums(trees)
    times = T.draws(row, trees)
    assert np.array_equal(count, [np.bincount(cell, t, 150)[drawn.cells] for t in times])
    assert not numbers or np.array_equal(total, [np.bincount(cell, t * label, 150)[drawn.cells] for t in times])


def test_pieces_of_a_task_give_the_same_trees(rows, monkeypatch):
    table = T.tree_table(rows.select("features", F.col("class").cast("double").alias("label"), "fold", "row"), "classification", 3)

    def grown():
        return T.forest(table.chunks, table.bins, [0, 1, 2], 5, 9, table.classes, 0.0, table.largest, table.rows, 1, 100)

    whole = grown()
    monkeypatch.setattr(T, "DRAWN_ROWS", 300)
    pieces = grown()
    assert all(np.array_equal(getattr(whole[k], name), getattr(pieces[k], name)) for k in whole for name in ("feature", "cut", "left", "value"))


def test_leaves_read_as_the_trees():
    bins = T.Bins([np.arange(20.0), np.arange(9.0)])
    data = np.column_stack([RNG.integers(21, size=900), RNG.integers(10, size=900)]).astype(np.uint8)
    made = []
    for seed in range(3):
        times = RNG.poisson(1.0, 900).astype(float)
        root = T.Trees.stumps(1, 2, np.array([seed], np.uint64))
        made.append(T.grow_alone(data, [times * (data[:, 0] % 2), times * RNG.integers(2, size=900), times], T.Rule(0.0, 1.0, 1e-12), root, 30))
    joined = [np.concatenate([getattr(t, k) for t in made]) for k in ("feature", "cut", "left", "value")]
    for depth in (0, 2, 1 << 20):
        leaves = T.Leaves.of(np.array([len(t.feature) for t in made]), *joined, depth)
        for i, tree in enumerate(made):
            assert np.array_equal(leaves.read(i, data), T.forest_sums([tree], data, [1], [depth])[0, 0])
        assert len(pickle.dumps(leaves)) < 0.65 * len(pickle.dumps(joined))
    assert bins.total == 31


def test_stages_go_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    values = [(i, float(x), "ab"[int(y) % 2], float(z)) for i, (x, y, z) in enumerate(zip(X[:, 0], X[:, 1], LABEL))][:600]
    df = spark.createDataFrame(values, "id long, x double, y string, label double")
    monkeypatch.setattr(M, "checkpoint_dir", lambda spark: str(tmp_path))
    fitted = fit_supervised(df, "id", "label", "regression", "randomforest", ["x", "y"], grid={"n_estimators": [4], "max_depth": [None]}, folds=2)
    kept = {name.split("-")[0] for name in os.listdir(tmp_path)}
    assert {"split", "predictions"} <= kept and not kept & {"filled", "train", "bins"}
    assert fitted.metrics.count() == 3 and fitted.predictions.count() == 120
