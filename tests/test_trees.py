"""Boosted trees and forests by histograms: prefixes, cuts, plans and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paperloom.operators.ml import trees as T
from paperloom.operators.ml.supervised import fit_supervised, load_model, save_model
from paperloom.plans.materialize import materialize

RNG = np.random.default_rng(21)
N = 400
X = np.column_stack([RNG.normal(size=N).round(2), RNG.integers(2, size=N), np.ones(N), RNG.integers(4, size=N)]).astype(float)
Y = np.where(X[:, 0] > 0, 3.0, -1.0) + X[:, 1] * X[:, 3] + RNG.normal(size=N) * 0.1
CLASS = (X[:, 3] + (X[:, 0] > 0.3)).astype(int) % 3
FOLD = np.arange(N) % 3


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(list(map(float, x)), float(y), int(k), int(f), i) for i, (x, y, k, f) in enumerate(zip(X, Y, CLASS, FOLD))]
    df = spark.createDataFrame(rows, "f array<double>, y double, k int, fold int, row long").withColumn("features", array_to_vector("f"))
    df = materialize(df.repartition(5))
    made = {}
    for module, label in (("regression", "y"), ("classification", "k")):
        train = df.select("features", F.col(label).cast("double").alias("label"), "fold", "row")
        made[module] = train, T.tree_table(train, module, 3)
    return made


def boosted(table, fits, rounds, marks, local_rows):
    base = np.zeros(len(fits)) if table.classes else np.array([table.means[f.fold] for f in fits])
    return T.boost(table.chunks, table.bins, fits, rounds, table.classes, base, 1.0 if table.classes else 8 * table.largest, table.rows, marks, local_rows)


def same(a, b):
    return all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "cut", "left", "value"))


@pytest.mark.parametrize("module", ["regression", "classification"])
def test_boosting_prefixes_and_plans(tables, module):
    table = tables[module][1]
    fits = [T.Boost(d, r, f) for d, r in ((2, 0.3), (4, 0.1)) for f in (0, 1, 2, -1)]
    long, scores = boosted(table, fits, 6, [3, 6], 1 << 15)
    short, few = boosted(table, fits, 3, [3], 1 << 15)
    spread, wide = boosted(table, fits, 6, [3, 6], 0)
    alone, one = boosted(table, fits[4:5], 6, [3, 6], 1 << 15)
    outputs = 3 if module == "classification" else 1
    for i in range(len(fits)):
        assert len(long[i]) == 6 * outputs
        assert all(same(a, b) for a, b in zip(long[i], short[i]))
        assert all(same(a, b) for a, b in zip(long[i], spread[i]))
    assert all(same(a, b) for a, b in zip(long[4], alone[0])) and np.array_equal(scores[6][4], one[6][0])
    assert np.array_equal(scores[3], few[3]) and np.allclose(scores[6], wide[6]) and np.allclose(scores[3], wide[3])
    held_out = scores[6][:3, 1].tolist()
    assert held_out == [(FOLD == f).sum() for f in range(3)]


def test_first_cut_against_all_cuts(tables):
    table = tables["regression"][1]
    (tree, *_), = boosted(table, [T.Boost(1, 1.0, -1)], 1, [1], 1 << 15)[0]
    g = Y - Y.mean()
    best = max(
        ((g[m].sum() ** 2 / (m.sum() + 1) + g[~m].sum() ** 2 / ((~m).sum() + 1), -i, -c) for i, cuts in enumerate(table.bins.cuts) for c in cuts for m in [X[:, i] <= c] if m.any() and (~m).any()),
    )
    assert (tree.feature[0], table.bins.cuts[tree.feature[0]][tree.cut[0]]) == (-best[1], -best[2])
    left = X[:, tree.feature[0]] <= -best[2]
    assert tree.value[1, 0] == pytest.approx(g[left].sum() / (left.sum() + 1)) and tree.value[2, 0] == pytest.approx(g[~left].sum() / ((~left).sum() + 1))


@pytest.mark.parametrize("module", ["regression", "classification"])
def test_forest_prefixes_cuts_and_plans(tables, module):
    table = tables[module][1]
    features = 2 if table.classes else 0
    center = 0.0 if table.classes else table.means[-1]

    def grown(n_trees, depth, local_rows):
        return T.forest(table.chunks, table.bins, [0, -1], n_trees, depth, table.classes, center, table.largest, table.rows, features, local_rows)

    deep, few, top, spread, mixed = grown(6, 1 << 20, 1 << 15), grown(3, 1 << 20, 1 << 15), grown(6, 2, 1 << 15), grown(6, 1 << 20, 0), grown(6, 1 << 20, 60)
    for key in few:
        assert same(deep[key], few[key])
    data = table.bins.of(X)
    for key, tree in deep.items():
        read = T.forest_sums([tree], data, [1], [2, 1 << 20])[0]
        assert np.array_equal(read[0], T.forest_sums([top[key]], data, [1], [1 << 20])[0, 0])
        for other in (spread, mixed):
            assert np.array_equal(read[1], T.forest_sums([other[key]], data, [1], [1 << 20])[0, 0])
    rows = T.draws(np.arange(N), np.array([0]))[0]
    if module == "regression":
        # grown until equal rows are together: a leaf is the mean of its draws
        value = T.forest_sums([deep[-1, 0]], data, [1], [1 << 20])[0, 0, :, 0] + center
        frame = pd.DataFrame({"k": list(map(bytes, data)), "w": rows, "wy": rows * Y})
        sums = frame.groupby("k")[["w", "wy"]].transform("sum")
        drawn = sums["w"] > 0
        assert np.allclose(value[drawn], (sums["wy"] / sums["w"])[drawn])


def test_draws_have_mean_one():
    times = T.draws(np.arange(20_000), np.arange(3))
    assert np.allclose(times.mean(1), 1, atol=0.03) and np.allclose(times.var(1), 1, atol=0.05)
    assert abs(np.corrcoef(times)[0, 1]) < 0.03


def test_searches_score_every_point(tables):
    train, _ = tables["regression"]
    grid = [{"n_estimators": n, "max_depth": d, "learning_rate": 0.3} for n in (2, 12) for d in (1, 3)]
    means, model = T.search_boosted(train, "regression", grid, 3)
    assert means.index(max(means)) == 3 and all(m < 0 for m in means)
    wide, again = T.search_boosted(train, "regression", grid, 3, local_rows=0)
    assert np.allclose(means, wide)
    a, b = ([r.prediction for r in m.transform(train).orderBy("row").collect()] for m in (model, again))
    assert np.array_equal(a, b) and np.mean((np.array(a) - Y) ** 2) < 0.2 * Y.var()
    points = [{"n_estimators": n, "max_depth": d} for n in (3, 5) for d in (None, 1)]
    means, model = T.search_forest(tables["classification"][0], "classification", points, 3)
    assert len(means) == 4 and max(means) > 0.9 and {r.prediction for r in model.transform(train).collect()} == {0.0, 1.0, 2.0}


@pytest.mark.parametrize("model,grid", [("xgboost", {"n_estimators": [4], "max_depth": [2], "learning_rate": [0.5]}), ("randomforest", {"n_estimators": [4], "max_depth": [3]})])
def test_saved_trees_predict_the_same(spark, tmp_path, model, grid):
    df = spark.createDataFrame([(i, float(x[0]), "abcd"[int(x[3])], "uvw"[k]) for i, (x, k) in enumerate(zip(X, CLASS))], "id long, x double, s string, k string")
    fitted = fit_supervised(df, "id", "k", "classification", model, ["x", "s"], grid=grid, folds=2)
    save_model(fitted.model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m")).transform(df).select("id", "predicted_label").join(fitted.predictions, "id")
    assert again.where("predicted_label <> predicted").count() == 0 and again.count() > 60


def test_constant_features_and_one_class(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 2)) for i in range(40)], "row long, x double, y double")
    train = materialize(df.select(array_to_vector(F.array("x")).alias("features"), F.lit(0.0).alias("label"), (F.col("row") % 2).cast("int").alias("fold"), "row"))
    for search, grid in ((T.search_boosted, {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.1}), (T.search_forest, {"n_estimators": 3, "max_depth": None})):
        for module in ("regression", "classification"):
            means, model = search(train, module, [grid], 2)
            assert means == [0.0 if module == "regression" else 1.0]
            assert {r.prediction for r in model.transform(train).collect()} == {0.0}
