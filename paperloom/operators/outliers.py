"""Interquartile-range outlier bounds, flags and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from paperloom.plans.orderstats import quantiles

FENCE = 1.5
MIN_VALUES = 4


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Those of ``columns`` (default: all) that exist and are numeric."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return numeric if columns is None else [c for c in columns if c in numeric]


def iqr_bounds(df: DataFrame, columns: Sequence[str], approx: bool = False, hot_rows: int = 100_000) -> DataFrame:
    """Rows ``(column, n, q1, q3, lower, upper)``; columns with fewer than four values are left out."""
    columns = numeric_columns(df, columns)
    if not columns:
        raise ValueError("no numeric column among those named")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if approx:
        q = F.percentile_approx("value", [0.25, 0.75], 10_000)
        quartiles = long.groupBy("column").agg(F.count("*").alias("n"), q.alias("q")).select(
            "column", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")
        )
    else:
        quartiles = quantiles(long, ["column"], "value", {"q1": 0.25, "q3": 0.75}, hot_rows=hot_rows)
    spread = F.col("q3") - F.col("q1")
    return quartiles.where(F.col("n") >= MIN_VALUES).select(
        "column", "n", "q1", "q3",
        (F.col("q1") - FENCE * spread).alias("lower"),
        (F.col("q3") + FENCE * spread).alias("upper"),
    )


def _enough_values(df: DataFrame, column: str) -> bool:
    return len(df.select(column).where(F.col(column).isNotNull()).take(MIN_VALUES)) == MIN_VALUES


def _flag(column: str, bounds: Column) -> Column:
    value, fence = F.col(column).cast("double"), bounds[column]
    outside = (value < fence["lower"]) | (value > fence["upper"])
    return F.when(outside, 1).otherwise(0).cast("int").alias(f"{column}_outlier")


def flag_outliers(
    df: DataFrame, columns: Sequence[str], approx: bool = False, hot_rows: int = 100_000
) -> DataFrame:
    """Add ``{column}_outlier``: 1 strictly outside the bounds, else 0 (also for NULL).

    The bounds reach the rows as one scalar subquery; there is no join.
    """
    usable = [c for c in numeric_columns(df, columns) if _enough_values(df, c)]
    if not usable:
        return df
    bounds = iqr_bounds(df, usable, approx, hot_rows)
    as_map = bounds.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("lower", "upper")))).alias("bounds")
    ).scalar()
    return df.select("*", *[_flag(c, as_map) for c in usable])


def outlier_summary(flagged: DataFrame) -> DataFrame:
    """Rows ``(column, outliers, percent)``; the percentage is of all rows."""
    flags = [c for c in flagged.columns if c.endswith("_outlier")]
    totals = flagged.agg(
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(flags)], F.count("*").alias("rows")
    )
    entries = [
        F.struct(
            F.lit(c.removesuffix("_outlier")).alias("column"),
            F.col(f"s{i}").alias("outliers"),
            (100.0 * F.col(f"s{i}") / F.col("rows")).alias("percent"),
        )
        for i, c in enumerate(flags)
    ]
    return totals.select(F.inline(F.array(*entries)))
