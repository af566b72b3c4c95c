"""Tables with few different rows of bins are grown from sums by place, with the same trees."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paperloom.operators.ml import trees as T
from paperloom.plans.materialize import materialize

RNG = np.random.default_rng(5)
N = 500
X = np.column_stack([RNG.normal(size=N).round(2), RNG.integers(2, size=N), RNG.integers(4, size=N)]).astype(float)
Y = np.where(X[:, 0] > 0, 3.0, -1.0) + X[:, 1] * X[:, 2] + RNG.normal(size=N)
CLASS = (X[:, 2] + (X[:, 0] > 0.3) + (RNG.random(N) < 0.1)).astype(int) % 3
FOLD = np.arange(N) % 3
FEW = 100  # places at most, and fewer than rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(list(map(float, x)), float(y), int(k), int(k > 0), int(f), i) for i, (x, y, k, f) in enumerate(zip(X, Y, CLASS, FOLD))]
    df = spark.createDataFrame(rows, "f array<double>, number double, three int, two int, fold int, row long").withColumn("features", array_to_vector("f"))
    df = materialize(df.repartition(4))
    out = {}
    for label in ("number", "two", "three"):
        train = df.select("features", F.col(label).cast("double").alias("label"), "fold", "row")
        out[label] = T.tree_table(train, "regression" if label == "number" else "classification", 3, 8)
    return out


def same(a, b):
    return all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "cut", "left")) and np.allclose(a.value, b.value, rtol=1e-9, atol=1e-8)


def test_places_are_all_rows_of_bins_or_none(tables):
    table = tables["number"]
    data = table.bins.of(X)
    places = T.Places.found(table.chunks, table.bins, FEW)
    assert {bytes(b) for b in places.bins} == {bytes(b) for b in data} and len(places.keys) < FEW
    assert np.array_equal(places.bins[places.of(table.bins, data)], data)
    assert T.Places.found(table.chunks, table.bins, len(places.keys) - 1) is None


@pytest.mark.parametrize("label", ["number", "two", "three"])
def test_boosting_by_place(tables, label, monkeypatch):
    table = tables[label]
    fits = [T.Boost(d, r, f) for d, r in ((2, 0.3), (4, 0.1)) for f in (0, 1, 2, -1)]
    base = np.zeros(len(fits)) if table.classes else np.array([table.means[f.fold] for f in fits])

    def boosted(local_rows):
        return T.boost(table.chunks, table.bins, fits, 5, table.classes, base, 1.0 if table.classes else 8 * table.largest, table.rows, [2, 5], local_rows)

    wide, scores = boosted(0)
    monkeypatch.setattr(T, "Passes", None)  # no pass over all rows
    few, placed = boosted(FEW)
    assert all(len(a) == len(b) and all(map(same, a, b)) for a, b in zip(wide, few))
    held_out = [i for i, f in enumerate(fits) if f.fold >= 0]
    for mark in (2, 5):
        assert np.allclose(np.array(scores[mark])[held_out], np.array(placed[mark])[held_out], rtol=1e-8)


@pytest.mark.parametrize("label", ["number", "two", "three"])
def test_forest_by_place(tables, label, monkeypatch):
    table = tables[label]
    center = 0.0 if table.classes else table.means[-1]

    def grown(depth, local_rows):
        return T.forest(table.chunks, table.bins, [0, 1, 2, -1], 5, depth, table.classes, center, table.largest, table.rows, 2 if table.classes else 0, local_rows)

    for depth in (2, 1 << 20):
        want = grown(depth, 1 << 15)
        with monkeypatch.context() as m:
            m.setattr(T, "level_sums", None)
            m.setattr(T, "_finished", None)
            few = grown(depth, FEW)
        assert want.keys() == few.keys() and all(same(want[k], few[k]) for k in want)


@pytest.mark.parametrize("label,module", [("number", "regression"), ("two", "classification"), ("three", "classification")])
def test_forest_scores_by_place(spark, label, module, monkeypatch):
    """Trees that only score stay with the tasks; the driver gets the best point's forest, cut at its depth."""
    target = {"number": Y, "two": CLASS > 0, "three": CLASS}[label]
    rows = [(list(map(float, x)), float(y), int(f), i) for i, (x, y, f) in enumerate(zip(X, target, FOLD))]
    df = spark.createDataFrame(rows, "f array<double>, label double, fold int, row long").repartition(3)
    train = materialize(df.select(array_to_vector("f").alias("features"), "label", "fold", "row"))
    points = [{"n_estimators": n, "max_depth": d} for n in (3, 7) for d in (None, 2, 4)]
    asked, forest = [], T.forest

    def noted(chunks, bins, folds, n_trees, depth, *more):
        asked.append((list(folds), n_trees, depth))
        return forest(chunks, bins, folds, n_trees, depth, *more)

    monkeypatch.setattr(T, "forest", noted)
    means, model = T.search_forest(train, module, points, 3)
    best = points[max(range(len(points)), key=lambda i: (means[i], -i))]
    assert asked == [([-1], best["n_estimators"], best["max_depth"] or 1 << 20)]
    by_rows, plain = T.search_forest(train, module, points, 3, 0)
    assert np.allclose(means, by_rows, rtol=1e-9)
    assert model.transform(train).collect() == plain.transform(train).collect()


@pytest.mark.parametrize("classes,looked_at", [(0, 0), (2, 2), (3, 1), (3, 0)])
def test_sorted_rows_give_the_cuts_of_histograms(classes, looked_at):
    rng = np.random.default_rng(classes)
    data = np.column_stack([rng.integers(9, size=400), rng.integers(2, size=400), np.zeros(400), rng.integers(5, size=400)]).astype(np.uint8)
    bins = T.Bins([np.arange(n - 1.0) for n in (9, 2, 1, 5)])
    times = rng.poisson(1.0, 400).astype(float)
    label = rng.integers(max(classes, 9), size=400)
    weights = [*[times * (label == k) for k in range(classes)], times] if classes else [times * label, times]
    rule = T.Rule(0.0, 1.0, 1e-12, looked_at)

    def root():
        return T.Trees.stumps(1, max(classes, 1), np.array([7], np.uint64))

    got, want = T.grow_alone(data, weights, rule, root(), 6), root()
    nodes = want.roots
    for _ in range(6):
        slots = np.full(len(want.feature), -1)
        slots[nodes] = np.arange(len(nodes))
        sums = T.add_up(bins, data, slots[want.route(data, np.zeros((1, 400), int))], [w[None] for w in weights], len(nodes))
        nodes, _ = T.grow_level(want, bins, rule, nodes, sums)
    assert len(want.feature) > 60
    assert all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("feature", "cut", "left", "value", "path"))
