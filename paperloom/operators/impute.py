"""Missing values: numeric mean, string mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, NumericType, StringType

ALL_MISSING = "missing"


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, value)``: the most frequent value, the smallest one on ties.

    Counted by (column, value) first, so a column with many distinct values is
    spread over all tasks (``mode()`` would hold its whole histogram in one).
    """
    long = df.select(*columns).unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill NULLs of numeric columns with the mean and of string columns with the mode.

    A string column without any value is filled with ``missing``; a numeric one
    stays NULL.  Filled integer columns become double, as a mean is one.
    """
    chosen = [f for f in df.schema.fields if columns is None or f.name in columns]
    numeric = [f.name for f in chosen if isinstance(f.dataType, NumericType)]
    text = [f.name for f in chosen if isinstance(f.dataType, StringType)]
    floats = {f.name for f in chosen if isinstance(f.dataType, FloatType)}
    fills = {}
    if numeric:
        # NaN is treated as missing
        clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
        means = df.agg(*[F.avg(e).alias(c) for c, e in clean.items()]).select(F.struct(*numeric)).scalar()
        for c in numeric:
            filled = F.coalesce(clean[c], means[c])
            fills[c] = filled.cast("float") if c in floats else filled
    if text:
        modes = (
            column_modes(df, text)
            .agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("modes"))
            .scalar()
        )
        for c in text:
            fills[c] = F.coalesce(F.col(c), modes[c], F.lit(ALL_MISSING))
    return df.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in df.columns])


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """One row ``(n_distinct, is_numeric)``."""
    numeric = isinstance(df.schema[target].dataType, NumericType)
    return df.agg(F.count_distinct(target).alias("n_distinct")).withColumn("is_numeric", F.lit(numeric))


def cardinality_guard(df: DataFrame, target: str, module: str) -> None:
    """Raise when the target does not suit the task."""
    profile = target_profile(df, target).first()
    if module == "classification" and profile.is_numeric and profile.n_distinct > 20:
        raise ValueError("target looks continuous: use regression")
    if module == "regression" and (not profile.is_numeric or profile.n_distinct <= 10):
        raise ValueError("target looks categorical: use classification")
