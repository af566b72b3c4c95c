"""Preparation and supervised models against closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from paperloom.operators.ml.metrics import classification_report, regression_metrics
from paperloom.operators.ml.prep import (
    add_folds,
    fit_preprocessor,
    fit_vectorizer,
    label_codes,
    select_features,
    split_flags,
    standardize,
    train_test_split,
)
from paperloom.operators.ml.supervised import (
    GRIDS,
    MODELS,
    expand_grid,
    fit_supervised,
    grid_search,
    lasso,
    linear,
    load_model,
    logistic,
    ridge,
    save_model,
    training_shapes,
)

from paperloom.plans.materialize import materialize


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 2)) * [1.0, 3.0]
    y = 2 * x[:, 0] - x[:, 1] + 4 + rng.normal(size=60)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    rows = [(i, [float(v) for v in r], float(t), float(t > 4)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, c double")
    return df.withColumn("features", array_to_vector("x")).cache()


def test_ridge_equals_closed_form(table, data):
    x, y = data
    train = table.withColumnRenamed("y", "label")
    centred = x - x.mean(0)
    for alpha in (0.01, 1, 100):
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(2), centred.T @ (y - y.mean()))
        model = ridge({"alpha": alpha}, training_shapes(train)[0]).fit(train)
        assert np.allclose(model.coefficients.toArray(), want, atol=1e-9)
        assert np.isclose(model.intercept, y.mean() - x.mean(0) @ want)


def test_lasso_equals_coordinate_descent(table, data):
    x, y = data
    train = table.withColumnRenamed("y", "label")
    centred, target = x - x.mean(0), y - y.mean()
    for alpha in (0.1, 1.0):
        w = np.zeros(2)
        for _ in range(2000):
            for j in range(2):
                rest = target - centred @ w + centred[:, j] * w[j]
                rho = centred[:, j] @ rest / len(y)
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (centred[:, j] @ centred[:, j] / len(y))
        model = lasso({"alpha": alpha}, training_shapes(train)[0]).fit(train)
        assert np.allclose(model.coefficients.toArray(), w, atol=1e-5)


def test_linear_without_intercept(table, data):
    x, y = data
    train = table.withColumnRenamed("y", "label")
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(linear({"fit_intercept": False}, training_shapes(train)[0]).fit(train).coefficients.toArray(), want)


def test_logistic_equals_newton(table, data):
    x, y = data
    t = (y > 4).astype(float)
    train = table.withColumnRenamed("c", "label")
    design = np.column_stack([x, np.ones(len(x))])
    for c in (0.1, 10):
        w = np.zeros(3)
        penalty = np.diag([1 / c, 1 / c, 0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-design @ w))
            w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - t) + penalty @ w)
        model = logistic({"C": c}, training_shapes(train)[0]).fit(train)
        assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=1e-4)


def test_grids_cover_every_model():
    assert set(GRIDS) == set(MODELS)
    assert [len(expand_grid(g)) for g in GRIDS.values()] == [2, 5, 5, 27, 6, 4, 27, 6]


def test_grid_search_picks_the_smallest_error(table):
    train = materialize(add_folds(table.withColumnRenamed("y", "label"), "id"))
    search = grid_search(train, "regression", ridge, [{"alpha": 1e6}, {"alpha": 0.1}], parallelism=2)
    assert search.best_params == {"alpha": 0.1}
    assert search.scores.where("best").count() == 1


def test_split_sizes_and_repeatability(spark, partitions):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("c"))
    seen = []
    for n, hot in ((1, 10), (8, 10), (8, 10**6)):
        partitions(n)
        flags = split_flags(df.repartition(n), "id", "c", hot_rows=hot).collect()
        seen.append(sorted(r.id for r in flags if r.is_test))
        counts = pd.Series([r.c for r in flags if r.is_test]).value_counts().to_dict()
        assert counts == {"common": 181, "rare": 21}
    assert seen[0] == seen[1] == seen[2]
    train, test = train_test_split(df, "id", test_size=0.25)
    assert (train.count(), test.count()) == (752, 251)


def test_folds_are_contiguous(spark):
    df = spark.range(23).select("id", (F.col("id") % 2).alias("c"))
    plain = [r.fold for r in add_folds(df, "id").orderBy("id").collect()]
    assert plain == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    by_label = add_folds(df, "id", "c", hot_rows=3).where("c = 0").orderBy("id").collect()
    assert [r.fold for r in by_label] == [0] * 3 + [1] * 3 + [2] * 2 + [3] * 2 + [4] * 2
    few = add_folds(spark.range(3), "id").orderBy("id").collect()
    assert [r.fold for r in few] == [0, 1, 2]


def test_features_and_codes(spark):
    df = spark.createDataFrame([("b", 1, 2.0, True), ("a", 2, 3.0, False)], "s string, i int, d double, y boolean")
    assert select_features(df) == ["s", "i", "d"] and select_features(df, supervised=False) == ["i", "d"]
    assert sorted(tuple(r) for r in label_codes(df, "s").collect()) == [("a", 0), ("b", 1)]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(float(v), 7.0) for v in (1, 2, 3, 10)], "x double, k double")
    x = np.array([1.0, 2, 3, 10])
    want = (x - x.mean()) / x.std()
    rows = standardize(df, ["x", "k"]).collect()
    assert np.allclose([r.x for r in rows], want) and {r.k for r in rows} == {0.0}
    vectors = fit_vectorizer(df, ["x", "k"]).transform(df).select(vector_to_array("features").alias("f")).collect()
    assert np.allclose([r.f for r in vectors], np.column_stack([want, np.zeros(4)]))


def test_unseen_category_is_all_zero(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0)], "s string, x double")
    test = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("z", 2.0)], "s string, x double")
    rows = fit_preprocessor(train, ["s", "x"]).transform(test).select(vector_to_array("features").alias("f")).collect()
    assert [list(r.f) for r in rows] == [[0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "actual double, predicted double")
    got = {r.metric: r.value for r in regression_metrics(df).collect()}
    assert got == pytest.approx({"RMSE": np.sqrt(2 / 3), "MAE": 2 / 3, "R2": 0.75})


def test_report_with_unmatched_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "actual string, predicted string")
    got = {(r.label, r.metric): r.value for r in classification_report(df).collect()}
    assert got["a", "precision"] == 0.5 and got["a", "recall"] == 0.5 and got["a", "f1_score"] == 0.5
    assert got["b", "precision"] == 0 and got["b", "recall"] == 0 and got["b", "support"] == 1
    assert got["c", "support"] == 0 and got["c", "f1_score"] == 0
    assert got["all", "accuracy"] == pytest.approx(1 / 3)
    assert got["macro avg", "precision"] == pytest.approx(0.5 / 3) and got["weighted avg", "recall"] == pytest.approx(1 / 3)


@pytest.fixture(scope="module")
def machines(spark):
    rng = np.random.default_rng(11)
    n = 240
    pdf = pd.DataFrame({"id": np.arange(n), "load": rng.normal(size=n), "heat": rng.normal(size=n), "site": rng.choice(["n", "s"], n)})
    pdf["price"] = 3 * pdf["load"] - 2 * (pdf["site"] == "s") + rng.normal(size=n) * 0.1
    pdf["state"] = np.where(pdf["load"] + 0.1 * rng.normal(size=n) > 0, "up", "down")
    pdf.loc[::17, "heat"] = np.nan
    return spark.createDataFrame(pdf).withColumn("heat", F.nanvl("heat", F.lit(None).cast("double"))).cache()


@pytest.mark.parametrize(
    "module,model,grid,metric,at_least",
    [
        ("regression", "ridge", {"alpha": [0.01, 100]}, "R2", 0.99),
        ("regression", "xgboost", {"n_estimators": [8], "max_depth": [3], "learning_rate": [0.5]}, "R2", 0.85),
        ("regression", "randomforest", {"n_estimators": [20], "max_depth": [None]}, "R2", 0.85),
        ("classification", "logistic", {"C": [0.1, 10]}, "accuracy", 0.9),
        ("classification", "xgboost", {"n_estimators": [5], "max_depth": [3], "learning_rate": [0.1]}, "accuracy", 0.85),
        ("classification", "randomforest", {"n_estimators": [10], "max_depth": [5]}, "accuracy", 0.85),
    ],
)
def test_models_learn(machines, module, model, grid, metric, at_least):
    target = "price" if module == "regression" else "state"
    fitted = fit_supervised(machines, "id", target, module, model, ["load", "heat", "site"], grid=grid, folds=3)
    values = {r.metric: r.value for r in fitted.metrics.where("label = 'all'").collect()}
    assert values[metric] > at_least
    n_test = fitted.predictions.count()
    assert 48 <= n_test <= 50 and fitted.predictions.columns == ["id", "actual", "predicted"]


def test_numeric_classes_keep_their_order_and_type(machines):
    noisy = F.col("load") + F.col("price") * 0.2
    df = machines.withColumn("grade", F.when(noisy > 1, 10).when(noisy > 0, 9).otherwise(2))
    fitted = fit_supervised(df, "id", "grade", "classification", "logistic", ["load"], grid={"C": [10]}, folds=3)
    assert dict(fitted.predictions.dtypes)["predicted"] == "int"
    assert {r.predicted for r in fitted.predictions.collect()} <= {2, 9, 10}


def test_saved_pipeline_predicts_the_same(machines, tmp_path):
    fitted = fit_supervised(machines, "id", "price", "regression", "linear", ["load", "site"], grid={"fit_intercept": [True]}, folds=2)
    save_model(fitted.model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m")).transform(machines).select("id", "prediction")
    both = again.join(fitted.predictions, "id")
    assert both.where("abs(prediction - predicted) > 1e-12").count() == 0 and both.count() > 0


def test_unsuitable_targets_and_models_are_rejected(machines):
    with pytest.raises(ValueError):
        fit_supervised(machines, "id", "price", "classification", "logistic", ["load"])
    with pytest.raises(ValueError):
        fit_supervised(machines, "id", "state", "regression", "linear", ["load"])
    with pytest.raises(ValueError):
        fit_supervised(machines, "id", "price", "regression", "svm", ["load"])


def test_rows_without_label_stay(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(30)], "id long, c string")
    flags = split_flags(df, "id", "c").collect()
    assert len(flags) == 30 and {c: sum(r.is_test for r in flags if r.c == c) for c in (None, "a", "b")} == {None: 2, "a": 2, "b": 2}
    folds = add_folds(df, "id", "c").collect()
    assert len(folds) == 30 and all(sum(r.fold == k and r.c is None for r in folds) == 2 for k in range(5))


def test_boolean_features_count(spark):
    df = spark.createDataFrame([(bool(i % 2), float(i)) for i in range(6)], "b boolean, x double")
    rows = fit_preprocessor(df, ["b", "x"], scale=False).transform(df).collect()
    assert [list(r.features) for r in rows] == [[float(r.b), r.x] for r in rows]
