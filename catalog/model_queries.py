"""Preparation, models, clustering, anomalies and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from paperloom.operators.ml.anomaly import anomaly_counts, isolation_forest
from paperloom.operators.ml.cluster import kmeans, pca
from paperloom.operators.ml.dbscan import dbscan
from paperloom.operators.ml.metrics import (
    calinski_harabasz,
    classification_report,
    clustering_metrics,
    davies_bouldin,
    regression_metrics,
    silhouette,
)
from paperloom.operators.ml.prep import add_folds, fit_preprocessor, label_codes, select_features, split_flags, standardize
from paperloom.operators.ml.supervised import fit_supervised, lasso, linear, ridge, training_shapes
from paperloom.plans.project import spread
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

REGRESSION_FEATURES = ["o_custkey", "o_orderstatus", "o_orderpriority"]
CLASS_FEATURES = ["o_custkey", "o_totalprice", "o_orderpriority"]


def _orders(spark, sf):
    return table(spark, sf, "orders")


@query("SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def encode_target(spark, sf):
    return label_codes(table(spark, sf, "customer"), "c_mktsegment")


@query(
    """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice,
       round((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders), 6) AS o_custkey FROM orders""",
    name="standardize",
)
def standardize_query(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(standardize(df, ["o_totalprice", "o_custkey"]), 6, "o_totalprice", "o_custkey")


@query(
    """WITH c AS (SELECT count(*) AS n FROM customer)
       SELECT 'supervised' AS task, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal']) AS feature, n FROM c
       UNION ALL SELECT 'unsupervised', unnest(['c_custkey', 'c_nationkey', 'c_acctbal']), n FROM c"""
)
def feature_columns(spark, sf):
    df = table(spark, sf, "customer")
    out = None
    for task, names in (("supervised", select_features(df)), ("unsupervised", select_features(df, supervised=False))):
        counts = df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n")
        counts = counts.select(F.lit(task).alias("task"), "feature", "n")
        out = counts if out is None else out.unionByName(counts)
    return out


@query(
    """SELECT o_orderstatus, CAST(count(*) - ceil(0.2 * count(*)) AS BIGINT) AS train_rows, CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows
       FROM orders GROUP BY 1"""
)
def stratified_split_sizes(spark, sf):
    flags = split_flags(_orders(spark, sf), "o_orderkey", "o_orderstatus", hot_rows=1000)
    return flags.groupBy("o_orderstatus").agg(
        F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows")
    )


@query(name="train_test_split")
def split_query(spark, sf):
    return split_flags(_orders(spark, sf), "o_orderkey").select("o_orderkey", "is_test")


@query(
    """SELECT o_orderkey, CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders"""
)
def stratified_folds(spark, sf):
    return add_folds(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", hot_rows=500).select("o_orderkey", "fold")


@query("""SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders""")
def folds(spark, sf):
    return add_folds(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query(
    """SELECT c_custkey, CAST(seen AND dense = 0 AS DOUBLE) AS h0, CAST(seen AND dense = 1 AS DOUBLE) AS h1,
       CAST(seen AND dense = 2 AS DOUBLE) AS h2, CAST(seen AND dense = 3 AS DOUBLE) AS h3
       FROM (SELECT c_custkey, c_mktsegment <> 'MACHINERY' AS seen, dense_rank() OVER (ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 'zzz' ELSE c_mktsegment END) - 1 AS dense FROM customer)"""
)
def one_hot(spark, sf):
    """Fitted without one segment, which then encodes to zeros."""
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    model = fit_preprocessor(df.where("c_mktsegment <> 'MACHINERY'"), ["c_mktsegment"])
    hot = model.transform(df).select("c_custkey", vector_to_array("features").alias("h"))
    return hot.select("c_custkey", *[F.col("h")[i].alias(f"h{i}") for i in range(4)])


@query(
    """WITH m AS (SELECT sqrt(avg((a - p) ** 2)) AS rmse, avg(abs(a - p)) AS mae, 1 - avg((a - p) ** 2) / var_pop(a) AS r2
       FROM (SELECT l_extendedprice AS a, l_quantity * 2000.0 AS p FROM lineitem))
       SELECT unnest(['RMSE', 'MAE', 'R2']) AS metric, 'all' AS label, round(unnest([rmse, mae, r2]), 4) AS value FROM m""",
    name="regression_metrics",
)
def regression_metrics_query(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000.0).alias("predicted")
    )
    return rounded(regression_metrics(df), 4, "value")


def report_sql(source: str) -> str:
    return f"""WITH pairs AS ({source}),
      labels AS (SELECT a AS label FROM pairs UNION SELECT p FROM pairs),
      c AS (SELECT label, (SELECT count(*) FROM pairs WHERE a = label) AS support,
        (SELECT count(*) FROM pairs WHERE p = label) AS chosen, (SELECT count(*) FROM pairs WHERE a = label AND p = label) AS tp FROM labels),
      r AS (SELECT *, CASE WHEN chosen > 0 THEN tp / chosen ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c),
      f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r),
      rows AS (SELECT label, unnest(['precision', 'recall', 'f1_score', 'support']) AS metric, unnest([precision, recall, f1, CAST(support AS DOUBLE)]) AS value FROM f
        UNION ALL SELECT 'macro avg', unnest(['precision', 'recall', 'f1_score', 'support']), unnest([avg(precision), avg(recall), avg(f1), CAST(sum(support) AS DOUBLE)]) FROM f
        UNION ALL SELECT 'weighted avg', unnest(['precision', 'recall', 'f1_score', 'support']),
          unnest([sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS DOUBLE)]) FROM f
        UNION ALL SELECT 'all', 'accuracy', sum(tp) / sum(support) FROM f)
      SELECT label, metric, round(value, 9) AS value FROM rows"""


@query(report_sql("SELECT CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS p FROM labels"), name="classification_report")
def classification_report_query(spark, sf):
    df = table(spark, sf, "labels").select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))
    return rounded(classification_report(df), 9, "value")


@query(
    report_sql(
        """SELECT event_type AS a, CASE WHEN value > 30 THEN 'purchase' WHEN value > 5 THEN 'view' ELSE 'bounce' END AS p FROM events"""
    )
)
def classification_report_unmatched(spark, sf):
    """Labels that are never predicted and one that never occurs."""
    guess = F.expr("CASE WHEN value > 30 THEN 'purchase' WHEN value > 5 THEN 'view' ELSE 'bounce' END")
    df = table(spark, sf, "events").select(F.col("event_type").alias("actual"), guess.alias("predicted"))
    return rounded(classification_report(df), 9, "value")


# cluster indices on the given labels ---------------------------------------------------
LONG_SQL = """long AS (SELECT vec_id, label, unnest(range(0, 64)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
  center AS (SELECT label, d, avg(x) AS c FROM long GROUP BY ALL),
  dist AS (SELECT l.vec_id, l.label, sum((x - c) ** 2) AS d2 FROM long l JOIN center USING (label, d) GROUP BY ALL)"""


@query(
    f"""WITH {LONG_SQL}, s AS (SELECT label, avg(sqrt(d2)) AS s FROM dist GROUP BY 1),
    gap AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ** 2)) AS g FROM center a JOIN center b USING (d) WHERE a.label <> b.label GROUP BY ALL),
    worst AS (SELECT i, max((si.s + sj.s) / g) AS r FROM gap JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY i)
    SELECT 'davies_bouldin_index' AS metric, 'all' AS label, round(avg(r), 6) AS value FROM worst""",
    name="davies_bouldin",
)
def davies_bouldin_query(spark, sf):
    return rounded(davies_bouldin(spread(table(spark, sf, "embeddings")), "embedding", "label"), 6, "value")


@query(
    f"""WITH {LONG_SQL}, mean AS (SELECT d, avg(x) AS m FROM long GROUP BY d),
    sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    b AS (SELECT sum(n * (c - m) ** 2) AS b FROM center JOIN mean USING (d) JOIN sizes USING (label)),
    w AS (SELECT sum(d2) AS w, count(*) AS n FROM dist), k AS (SELECT count(*) AS k FROM sizes)
    SELECT 'calinski_harabasz_index' AS metric, 'all' AS label, round((b / (k - 1)) / (w / (n - k)), 6) AS value FROM b, w, k""",
    name="calinski_harabasz",
)
def calinski_harabasz_query(spark, sf):
    return rounded(calinski_harabasz(spread(table(spark, sf, "embeddings")), "embedding", "label"), 6, "value")


@query(
    """WITH gaps AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS total
      FROM embeddings a, embeddings b GROUP BY ALL),
    sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN total / (n - 1) END) AS a,
      min(CASE WHEN own <> other THEN total / n END) AS b FROM gaps JOIN sizes ON sizes.label = other GROUP BY vec_id)
    SELECT 'silhouette_score' AS metric, 'all' AS label, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS value FROM ab""",
    name="silhouette",
)
def silhouette_query(spark, sf):
    return rounded(silhouette(spread(table(spark, sf, "embeddings")), "vec_id", "embedding", "label"), 6, "value")


@query(name="kmeans")
def kmeans_query(spark, sf):
    out, _ = kmeans(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return out.select("c_custkey", "cluster")


@query()
def kmeans_metrics(spark, sf):
    out, _ = kmeans(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return clustering_metrics(out, "o_orderkey")


@query(name="pca")
def pca_query(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    coordinates, _, _ = pca(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *columns), columns)
    return coordinates.select("l_orderkey", "l_linenumber", F.col("coordinates")[0].alias("c0"), F.col("coordinates")[1].alias("c1"))


@query()
def pca_ratios(spark, sf):
    _, ratios, _ = pca(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return ratios


# on a line, density clusters are runs of core points with gaps up to eps
DBSCAN_LINE_SQL = """p AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer),
  n AS (SELECT id, x, count(*) OVER (ORDER BY x RANGE BETWEEN 4.0 PRECEDING AND 4.0 FOLLOWING) >= 5 AS core FROM p),
  runs AS (SELECT id, x, sum(CASE WHEN gap <= 4.0 THEN 0 ELSE 1 END) OVER (ORDER BY x, id) AS run FROM (
    SELECT id, x, x - lag(x) OVER (ORDER BY x, id) AS gap FROM n WHERE core)),
  numbered AS (SELECT id, x, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM (
    SELECT id, x, min(id) OVER (PARTITION BY run) AS first FROM runs)),
  edge AS (SELECT n.id, min(c.cluster) AS cluster FROM n JOIN numbered c ON c.x BETWEEN n.x - 4.0 AND n.x + 4.0 WHERE NOT n.core GROUP BY n.id)"""


@query(
    f"""WITH {DBSCAN_LINE_SQL} SELECT n.id AS c_custkey, CAST(coalesce(numbered.cluster, edge.cluster, -1) AS INTEGER) AS cluster
    FROM n LEFT JOIN numbered ON numbered.id = n.id LEFT JOIN edge ON edge.id = n.id"""
)
def dbscan_on_a_line(spark, sf):
    return dbscan(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"], eps=4.0)


@query(name="dbscan")
def dbscan_query(spark, sf):
    columns = ["o_totalprice", "o_custkey"]
    return dbscan(standardize(_orders(spark, sf), columns), "o_orderkey", columns, eps=0.05)


@query(name="isolation_forest")
def isolation_forest_query(spark, sf):
    columns = ["o_totalprice", "o_custkey"]
    return isolation_forest(_orders(spark, sf), "o_orderkey", columns).select("o_orderkey", F.round("score", 9).alias("score"), "label")


@query()
def isolation_forest_counts(spark, sf):
    return anomaly_counts(isolation_forest(table(spark, sf, "events"), "event_id", ["value", "user_id"]))


# models; every one searches its whole default grid --------------------------------------------------
def _register_model(name: str, module: str, model: str, target: str, features: list[str], grid: dict | None) -> None:
    @query(name=name)
    def run(spark, sf):
        """Metrics of the test rows."""
        fitted = fit_supervised(_orders(spark, sf), "o_orderkey", target, module, model, features, grid=grid)
        return fitted.metrics


_register_model("linear_regression", "regression", "linear", "o_totalprice", REGRESSION_FEATURES, None)
_register_model("ridge_regression", "regression", "ridge", "o_totalprice", REGRESSION_FEATURES, None)
_register_model("lasso_regression", "regression", "lasso", "o_totalprice", REGRESSION_FEATURES, None)
_register_model("boosted_regression", "regression", "xgboost", "o_totalprice", REGRESSION_FEATURES, None)
_register_model("forest_regression", "regression", "randomforest", "o_totalprice", REGRESSION_FEATURES, None)
_register_model("logistic_classification", "classification", "logistic", "o_orderstatus", CLASS_FEATURES, None)
_register_model("boosted_classification", "classification", "xgboost", "o_orderstatus", CLASS_FEATURES, None)
_register_model("forest_classification", "classification", "randomforest", "o_orderstatus", CLASS_FEATURES, None)


@query()
def model_predictions(spark, sf):
    """Actual and predicted labels of the test rows."""
    fitted = fit_supervised(
        _orders(spark, sf), "o_orderkey", "o_orderstatus", "classification", "logistic", CLASS_FEATURES
    )
    return fitted.predictions


@query(
    """WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
        regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem),
    w AS (SELECT 'linear' AS model, sxy / sxx AS slope, mx, my FROM m
      UNION ALL SELECT 'ridge', sxy / (sxx + 1000000), mx, my FROM m
      UNION ALL SELECT 'lasso', sign(sxy) * greatest(abs(sxy) / n - 5000, 0) / (sxx / n), mx, my FROM m)
    SELECT model, round(slope, 3) AS slope, round(my - slope * mx, 2) AS intercept FROM w"""
)
def linear_closed_forms(spark, sf):
    """The linear models with one feature on all rows, where the solution is a formula."""
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("label"))
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    (shape,) = training_shapes(train)
    made = [
        ("linear", linear({"fit_intercept": True}, shape)),
        ("ridge", ridge({"alpha": 1_000_000.0}, shape)),
        ("lasso", lasso({"alpha": 5_000.0}, shape)),
    ]
    found = [(name, float(m.coefficients[0]), float(m.intercept)) for name, e in made for m in [e.fit(train)]]
    out = spark.createDataFrame(found, "model string, slope double, intercept double")
    return rounded(rounded(out, 3, "slope"), 2, "intercept")
