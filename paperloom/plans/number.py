"""Consecutive numbers in sort order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_rows(ordered: DataFrame, name: str) -> DataFrame:
    """Add the 0-based position of each row of a sorted one-column table.

    ``row_number`` without a partition would gather all rows in one task; this counts
    the sorted partitions and numbers each in place.
    """
    (column,) = ordered.columns
    indexed = ordered.rdd.zipWithIndex().map(lambda pair: (pair[0][0], pair[1]))
    kind = ordered.schema[column].dataType.simpleString()
    numbered = ordered.sparkSession.createDataFrame(indexed, f"{column} {kind}, {name} long")
    return numbered.withColumn(name, F.col(name).cast("int"))
