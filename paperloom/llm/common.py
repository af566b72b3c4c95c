"""Helpers of the corpus operators: bounded batches, written stages, boxed rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.materialize import checkpoint_dir

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, zstd-compressed, under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame, **parts: Column) -> DataFrame:
    """All columns of a row as one struct ``_row`` beside named parts, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in parts.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that name a row by its content; rows that agree in id and text are one row many times."""
    return [
        F.xxhash64(F.lit(1), doc_id, F.col(text).isNull(), text).alias("_ka"),
        F.xxhash64(F.lit(2), text, F.col(doc_id).isNull(), doc_id).alias("_kb"),
    ]


def utf8(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not len(values):
            continue
        sizes = np.cumsum([0 if v is None else v for v in pa.compute.binary_length(values).to_pylist()])
        start = 0
        while start < len(values):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def field_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
