"""Aggregation, outliers, imputation, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from paperloom.operators.aggregate import aggregate
from paperloom.operators.impute import column_modes, impute, target_profile
from paperloom.operators.outliers import flag_outliers, iqr_bounds, outlier_summary
from paperloom.plans.materialize import checkpoint_dir
from paperloom.plans.orderstats import quantiles
from paperloom.sources.tables import load_documents, load_table, output_names, write_csv, write_json

@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean,
       min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, count(l_quantity) AS l_quantity_count,
       count(*) AS l_quantity_size, count(DISTINCT l_quantity) AS l_quantity_nunique, median(l_quantity) AS l_quantity_median,
       round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std,
       round(var_samp(l_extendedprice) / 1e6, 4) AS l_extendedprice_var, round(median(l_extendedprice), 4) AS l_extendedprice_median
       FROM lineitem GROUP BY ALL"""
)
def aggregate_lineitem(spark, sf):
    out = aggregate(
        table(spark, sf, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "l_quantity": ["sum", "mean", "min", "max", "count", "size", "nunique", "median"],
            "l_extendedprice": ["std", "var", "median"],
        },
    ).withColumn("l_extendedprice_var", F.col("l_extendedprice_var") / 1e6)
    out = rounded(out, 4, "l_extendedprice_std", "l_extendedprice_var", "l_extendedprice_median")
    return rounded(rounded(out, 2, "l_quantity_sum"), 6, "l_quantity_mean")


@query(
    """SELECT o_orderpriority, round(median(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1"""
)
def median_hot_groups(spark, sf):
    """Groups over the size limit take the bucketed path."""
    out = aggregate(table(spark, sf, "orders"), ["o_orderpriority"], {"o_totalprice": "median"}, hot_rows=500)
    return rounded(out, 4, "o_totalprice")


@query(
    """WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders)
    SELECT o_custkey, arg_min_null(price, o_orderkey) AS price_first, arg_max_null(price, o_orderkey) AS price_last,
      count(price) AS price_count, bool_or(price IS NULL) AS price_holes FROM o GROUP BY o_custkey"""
)
def aggregate_first_last(spark, sf):
    df = table(spark, sf, "orders").withColumn("price", F.expr("CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END"))
    df = df.withColumn("hole", F.col("price").isNull())
    out = aggregate(
        df, ["o_custkey"], {"price": ["first", "last", "count"], "hole": ["any"]}, order_by="o_orderkey", sort=False
    )
    return out.withColumnRenamed("hole_any", "price_holes")


@query(
    """SELECT user_id, round(stddev_samp(value) / sqrt(count(value)), 9) AS value_sem,
      round(skewness(value), 6) AS value_skew, bool_or(value > 200) AS high_any, bool_and(value > 0.05) AS low_all,
      min(event_id) FILTER (WHERE value = lo) AS value_idxmin, min(event_id) FILTER (WHERE value = hi) AS value_idxmax,
      round(product(1 + value / 10000), 6) AS growth_prod
    FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)
    GROUP BY 1"""
)
def aggregate_other_reductions(spark, sf):
    value = F.col("value")
    df = table(spark, sf, "events").withColumns({"high": value > 200, "low": value > 0.05, "growth": 1 + value / 10000})
    out = aggregate(
        df,
        ["user_id"],
        {"value": ["sem", "skew", "idxmin", "idxmax"], "high": ["any"], "low": ["all"], "growth": ["prod"]},
        order_by="event_id",
    )
    return rounded(rounded(out, 9, "value_sem"), 6, "value_skew", "growth_prod")


@query(
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice, count(DISTINCT o_orderpriority) AS o_orderpriority
       FROM (SELECT *, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) WHERE k IS NOT NULL GROUP BY o_custkey"""
)
def aggregate_null_keys(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_custkey % 10 > 0 THEN o_custkey END"))
    out = aggregate(df, ["o_custkey"], {"o_totalprice": "sum", "o_orderpriority": "nunique"})
    return rounded(out, 2, "o_totalprice")


@query(
    """SELECT count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50,
       round(quantile_cont(o_totalprice, 0.999), 4) AS p999 FROM orders"""
)
def global_quantiles(spark, sf):
    out = quantiles(table(spark, sf, "orders"), [], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p999": 0.999})
    return rounded(out, 4, "p10", "p50", "p999")


MEASURES = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount"], "events": ["value"]}
BOUNDS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}"""
    for t, columns in MEASURES.items()
    for c in columns
)


@query(
    f"""SELECT "column", n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower,
        round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM ({BOUNDS_SQL})""",
    name="iqr_bounds",
)
def iqr_bounds_query(spark, sf):
    out = None
    for name, columns in MEASURES.items():
        bounds = iqr_bounds(table(spark, sf, name), columns, hot_rows=1000)
        out = bounds if out is None else out.unionByName(bounds)
    return rounded(out, 4, "q1", "q3", "lower", "upper")


VALUE_BOUNDS = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v)"
FLAG_SQL = f"""v AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS value FROM events),
 flagged AS (SELECT event_id, value, CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END AS value_outlier
 FROM v, {VALUE_BOUNDS} b)"""


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_type <> 'view' THEN value END AS value"))


@query(f"WITH {FLAG_SQL} SELECT * FROM flagged", name="flag_outliers")
def flag_outliers_query(spark, sf):
    return flag_outliers(_events(spark, sf), ["value"])


@query(
    f"""WITH {FLAG_SQL} SELECT 'value' AS "column", CAST(sum(value_outlier) AS BIGINT) AS outliers,
        round(100.0 * sum(value_outlier) / count(*), 6) AS percent FROM flagged""",
    name="outlier_summary",
)
def outlier_summary_query(spark, sf):
    return rounded(outlier_summary(flag_outliers(_events(spark, sf), ["value"])), 6, "percent")


HOLES = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS o_orderpriority, CAST(NULL AS VARCHAR) AS note FROM orders"""


def _holes(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS o_totalprice"),
        F.expr("CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS o_custkey"),
        F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS o_orderpriority"),
        F.lit(None).cast("string").alias("note"),
    )


MODE_SQL = "(SELECT o_orderpriority FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    f"""WITH h AS ({HOLES}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM h)), 4) AS o_totalprice,
      round(CAST(coalesce(o_custkey, (SELECT avg(o_custkey) FROM h)) AS DOUBLE), 6) AS o_custkey,
      coalesce(o_orderpriority, {MODE_SQL}) AS o_orderpriority, 'missing' AS note FROM h""",
    name="impute",
)
def impute_query(spark, sf):
    out = impute(_holes(spark, sf), ["o_totalprice", "o_custkey", "o_orderpriority", "note"])
    return rounded(rounded(out, 4, "o_totalprice"), 6, "o_custkey")


@query(
    """WITH long AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer UNION ALL SELECT 'c_name', c_name FROM customer),
      n AS (SELECT "column", value, count(*) AS c FROM long GROUP BY ALL)
    SELECT "column", value FROM n QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, value) = 1""",
    name="column_modes",
)
def column_modes_query(spark, sf):
    return column_modes(table(spark, sf, "customer"), ["c_mktsegment", "c_name"])


@query(
    """SELECT 'l_returnflag' AS target, count(DISTINCT l_returnflag) AS n_distinct, false AS is_numeric FROM lineitem
       UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), true FROM lineitem
       UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), true FROM lineitem"""
)
def cardinality_profile(spark, sf):
    df = table(spark, sf, "lineitem")
    out = None
    for target in ("l_returnflag", "l_extendedprice", "l_linenumber"):
        profile = target_profile(df, target).select(F.lit(target).alias("target"), "*")
        out = profile if out is None else out.unionByName(profile)
    return out


# sources and sinks: each table is written to the shared folder and read back -------------
def _path(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


CUSTOMER_SQL = """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"""


def _customer(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal"),
        F.expr("nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment"),
    )


@query(CUSTOMER_SQL.replace("c_nationkey,", "CAST(c_nationkey AS BIGINT) AS c_nationkey,"))
def csv_round_trip(spark, sf):
    """NULLs are written as NA, so the reader has to recognise them; types come from the values."""
    path = _path(spark, "customer") + ".csv"
    text = _customer(spark, sf)
    write_csv(text.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in text.columns]), path)
    return load_table(spark, path)


@query(CUSTOMER_SQL.replace("c_nationkey,", "CAST(c_nationkey AS BIGINT) AS c_nationkey,"))
def json_round_trip(spark, sf):
    path = _path(spark, "customer") + ".jsonl"
    write_json(_customer(spark, sf), path)
    return load_table(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("""SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier""")
def json_array_table(spark, sf):
    """JSON arrays of at most a thousand records, one per file."""
    path = _path(spark, "supplier") + ".json"
    rows = table(spark, sf, "supplier")
    records = F.sort_array(F.collect_list(F.struct(*rows.columns)))
    arrays = rows.groupBy(F.floor(F.col("s_suppkey") / 1000).alias("part")).agg(F.to_json(records).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return load_table(spark, path).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(
    """SELECT source, regexp_replace(source, '\\.html$', '') || CASE doc_kind WHEN 0 THEN '_cleaned.txt' WHEN 1 THEN '_parsed.txt'
      WHEN 2 THEN '_' || lang || '.txt' ELSE '.txt' END AS out_name
    FROM (SELECT source || '.' || doc_id || '.html' AS source, lang, doc_id % 4 AS doc_kind FROM documents)"""
)
def document_output_names(spark, sf):
    df = table(spark, sf, "documents").select(
        F.concat_ws(".", "source", "doc_id", F.lit("html")).alias("source"), "lang", (F.col("doc_id") % 4).alias("kind")
    )
    out = None
    for i, kind in enumerate(("text", "pdf", "excel", "other")):
        named = output_names(df.where(F.col("kind") == i), "source", kind, "lang").select("source", "out_name")
        out = named if out is None else out.unionByName(named)
    return out


@query(
    """SELECT CAST(floor(s_suppkey / 20) AS BIGINT) AS part, string_agg(s_name || ' ' || s_nationkey || chr(10), '' ORDER BY s_suppkey) AS text
       FROM supplier GROUP BY 1""",
    name="load_documents",
)
def load_documents_query(spark, sf):
    """Text files of twenty suppliers each, written by the tasks and read back whole."""
    path = _path(spark, "texts")
    part = F.floor(F.col("s_suppkey") / 20).alias("part")
    rows = table(spark, sf, "supplier").select(part, "s_suppkey", F.concat_ws(" ", "s_name", "s_nationkey").alias("value"))
    rows = rows.repartition("part").sortWithinPartitions("part", "s_suppkey").drop("s_suppkey")
    rows.write.partitionBy("part").text(path)
    files = load_documents(spark, f"{path}/*", "*.txt")
    return files.select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("part"), "text")
