"""Registration helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` with its optional SQL."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named columns; adding 0.0 turns a negative zero into zero."""
    chosen = {c: (F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in columns}
    return df.select(*[chosen.get(c, F.col(c)) for c in df.columns])


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keyword): every distinct word of the documents, the part names, the segments and the nations."""
    parts: list[tuple[str, Column]] = [
        ("documents", F.col("text")),
        ("part", F.concat_ws(" ", "p_name", "p_type")),
        ("customer", F.col("c_mktsegment")),
        ("nation", F.col("n_name")),
    ]
    out = None
    for name, text in parts:
        rows = table(spark, sf_dir, name).select(
            F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("keyword")
        )
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


WORDS_SQL = """words AS (
  SELECT DISTINCT keyword FROM (
    SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS keyword FROM documents
    UNION ALL SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '\\p{L}+')) FROM part
    UNION ALL SELECT unnest(regexp_extract_all(lower(c_mktsegment), '\\p{L}+')) FROM customer
    UNION ALL SELECT unnest(regexp_extract_all(lower(n_name), '\\p{L}+')) FROM nation))"""
