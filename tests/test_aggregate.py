import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators.aggregate import AGGREGATES, aggregate, category_distribution
from paperloom.operators.impute import cardinality_guard, impute
from paperloom.operators.outliers import flag_outliers, iqr_bounds, outlier_summary
from paperloom.plans.orderstats import order_statistics, quantiles

ROWS = [("b", 1.0, 5, 0), ("a", 2.0, 6, 1), ("a", 4.0, None, 2), (None, 9.0, 9, 3), ("b", None, 7, 4)]


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, "g string, x double, y int, ord int")


def test_null_keys_drop_and_output_is_sorted(table):
    out = aggregate(table, ["g"], {"x": "sum"})
    assert out.columns == ["g", "x"] and [tuple(r) for r in out.collect()] == [("a", 6.0), ("b", 1.0)]


def test_names_follow_the_widest_request(table):
    assert aggregate(table, ["g"], {"x": ["sum"], "y": "max"}).columns == ["g", "x", "y"]
    assert aggregate(table, ["g"], {"x": "sum", "y": ["max", "min"]}).columns == ["g", "x_sum", "y_max", "y_min"]


def test_first_and_last_keep_null(table):
    out = aggregate(table, ["g"], {"x": ["first", "last"], "y": ["first", "last"]}, order_by="ord")
    assert [tuple(r) for r in out.collect()] == [("a", 2.0, 4.0, 6, None), ("b", 1.0, None, 5, 7)]


def test_ordered_functions_need_an_order(table):
    with pytest.raises(ValueError):
        aggregate(table, ["g"], {"x": "first"})
    with pytest.raises(ValueError):
        aggregate(table, ["g"], {"x": "nope"})
    with pytest.raises(ValueError):
        aggregate(table, ["h"], {"x": "sum"})


def test_empty_sums_and_single_rows(table):
    out = aggregate(table.where("g = 'b'"), ["g"], {"x": ["sum", "std", "var", "sem", "prod"]}).first()
    assert (out.x_sum, out.x_std, out.x_var, out.x_sem, out.x_prod) == (1.0, None, None, None, 1.0)
    nothing = aggregate(table.where("ord = 4"), ["g"], {"x": ["sum", "prod", "any", "all", "median", "count", "size"]}).first()
    assert tuple(nothing)[1:] == (0.0, 1.0, False, True, None, 0, 1)


def test_key_that_is_also_aggregated(table):
    assert aggregate(table, ["g"], {"g": "count", "x": "max"}).columns == ["g", "x"]


def test_callers_may_add_functions(table):
    out = aggregate(table, ["g"], {"x": "span"}, functions={"span": lambda c, o: F.max(c) - F.min(c)})
    assert [r.x for r in out.collect()] == [2.0, 0.0]
    assert "span" not in AGGREGATES


def test_matches_pandas_on_random_data(spark, partitions):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["p", "q", "r"], 500, p=[0.7, 0.2, 0.1]), "x": rng.gamma(2, 3, 500).round(2), "o": np.arange(500)})
    names = ["sum", "mean", "std", "var", "median", "sem", "skew", "nunique", "idxmin", "idxmax"]
    want = pdf.set_index("o").groupby("g")["x"].agg(names)
    for n in (1, 8):
        partitions(n)
        for hot in (10, 10_000):
            got = aggregate(spark.createDataFrame(pdf), ["g"], {"x": names}, order_by="o", hot_rows=hot).toPandas().set_index("g")
            for name in names:
                assert np.allclose(got[f"x_{name}"].astype(float), want[name].astype(float)), name


def test_category_distribution(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "category string")
    assert [tuple(r) for r in category_distribution(df).collect()] == [("b", 2), ("a", 1), ("c", 1)]


@pytest.mark.parametrize("shape", ["spread", "copies", "outlier", "tiny"])
def test_quantiles_are_exact_for_hot_and_cold_groups(spark, shape):
    rng = np.random.default_rng(5)
    x = {
        "spread": rng.normal(0, 1, 3000),
        "copies": rng.choice([1.0, 2.0, 2.0, 2.0, 7.5], 3000),
        "outlier": np.append(rng.uniform(0, 1, 2999), 1e300),
        "tiny": np.array([3.0, -1.0]),
    }[shape]
    pdf = pd.DataFrame({"k": np.where(np.arange(len(x)) % 10 == 0, "cold", "hot"), "x": x})
    df = spark.createDataFrame(pdf).repartition(5)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for hot_rows in (500, 10**6):
        got = {r.k: r for r in quantiles(df, ["k"], "x", shares, hot_rows=hot_rows).collect()}
        for key, part in pdf.groupby("k"):
            assert got[key].n == len(part)
            for name, share in shares.items():
                assert np.isclose(got[key][name], np.quantile(part["x"], share), rtol=1e-12)
    whole = quantiles(df, [], "x", shares).first()
    assert all(np.isclose(whole[n], np.quantile(x, s), rtol=1e-12) for n, s in shares.items())


def test_order_statistics_on_empty_input(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert order_statistics(df, ["k"], "x", {"m": (0.5, lambda n: F.floor(n / 2))}).count() == 0


def test_iqr_skip_rules(spark):
    df = spark.createDataFrame(
        [(1.0, 5, "s", None), (2.0, 5, "t", 1.0), (3.0, 5, "u", 1.0), (100.0, 5, "v", 1.0), (None, 5, "w", None)],
        "x double, c int, s string, few double",
    )
    out = flag_outliers(df, ["x", "c", "s", "few", "absent"])
    assert [c for c in out.columns if c.endswith("_outlier")] == ["x_outlier", "c_outlier"]
    assert sorted((r.x is None, r.x or 0, r.x_outlier, r.c_outlier) for r in out.collect()) == [
        (False, 1.0, 0, 0), (False, 2.0, 0, 0), (False, 3.0, 0, 0), (False, 100.0, 1, 0), (True, 0, 0, 0),
    ]
    assert sorted(tuple(r) for r in outlier_summary(out).collect()) == [("c", 0, 0.0), ("x", 1, 20.0)]
    bounds = {r.column: (r.q1, r.q3) for r in iqr_bounds(df, ["x", "c", "few"]).collect()}
    assert bounds == {"x": (1.75, 27.25), "c": (5.0, 5.0)}


def test_bounds_reach_the_rows_without_a_join(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), "id")
    plan = flag_outliers(df, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan


def test_approximate_bounds(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    row = iqr_bounds(df, ["x"], approx=True).first()
    assert abs(row.q1 - 249.75) < 2 and abs(row.q3 - 749.25) < 2


def test_impute(spark):
    df = spark.createDataFrame(
        [("b", None, None, 1, 1.0), ("a", None, None, None, float("nan")), ("b", None, None, 4, 4.0), ("a", None, None, 1, None), (None, None, None, 2, 4.0)],
        "s string, empty string, blank double, n int, d double",
    )
    rows = impute(df).collect()
    assert [r.s for r in rows] == ["b", "a", "b", "a", "a"]  # the smaller of two equally frequent values
    assert {r.empty for r in rows} == {"missing"} and {r.blank for r in rows} == {None}
    assert [r.n for r in rows] == [1.0, 2.0, 4.0, 1.0, 2.0] and [r.d for r in rows] == [1.0, 3.0, 4.0, 3.0, 4.0]


def test_extremes_of_text_dates_and_truths(spark):
    day = lambda d: datetime.date(2024, 1, d)
    rows = [("a", "x", day(3), True, 4), ("a", "z", day(9), None, 3), ("a", "z", day(9), True, 1), ("b", None, None, None, 7), ("b", "é", day(2), False, 8)]
    df = spark.createDataFrame(rows, "g string, s string, d date, t boolean, ord int").withColumn("at", F.date_add(F.lit("2020-01-01"), F.col("ord")))
    out = aggregate(df, ["g"], {c: ["idxmin", "idxmax"] for c in ("s", "d", "t")}, order_by="ord").collect()
    assert [tuple(r) for r in out] == [("a", 4, 1, 4, 1, 1, 1), ("b", 8, 8, 8, 8, 8, 8)]
    by_day = aggregate(df, ["g"], {"s": "idxmax", "at": "idxmax"}, order_by="at").collect()
    assert [(r.s, r["at"]) for r in by_day] == [(datetime.date(2020, 1, 2), datetime.date(2020, 1, 5)), (datetime.date(2020, 1, 9), datetime.date(2020, 1, 9))]
    with pytest.raises(ValueError):
        aggregate(df, ["g"], {"d": "idxmax"}, order_by="s")


def test_cardinality_guard(spark):
    df = spark.range(30).select(F.col("id").alias("many"), (F.col("id") % 3).alias("few"), F.lit("s").alias("text"))
    cardinality_guard(df, "many", "regression")
    cardinality_guard(df, "few", "classification")
    cardinality_guard(df, "text", "classification")
    for target, module in (("many", "classification"), ("few", "regression"), ("text", "regression")):
        with pytest.raises(ValueError):
            cardinality_guard(df, target, module)
