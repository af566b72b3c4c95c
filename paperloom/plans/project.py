"""Projection helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_column_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read but must not repeat.

    A filter is pushed below a projection by copying its expressions into the
    filter; it is not pushed below a generator, so the value is computed once.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    Only a scan with fewer splits than cores is repartitioned, as happens with a
    single small file; a large input is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
