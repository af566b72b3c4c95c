"""Row-wise operators over files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    fmt: str = "parquet",
) -> None:
    """Apply a row-wise operator to the files not seen yet, append the result, and stop.

    The checkpoint remembers the files done, so each is processed exactly once.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
