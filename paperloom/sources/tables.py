"""Readers and writers for tables, documents, seed lists, chunks and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from paperloom.functions.urls import base_name
from paperloom.sources.csv_splits import read_csv_splits

# --- fixed values: must equal the expected output ---------------------------------
# spellings that the table readers take for a missing value
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CLEANED, PARSED = "_cleaned.txt", "_parsed.txt"
# -----------------------------------------------------------------------------------

_INTEGER = r"^\s*[+-]?\d{1,19}\s*\z"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*\z|^\s*[+-]?(inf|Infinity)\s*\z"
_BOOLEAN = ("True", "False", "TRUE", "FALSE", "true", "false")


def missing_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL for every NA spelling in string columns and for NaN in floating ones."""
    out = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if columns is None or field.name in columns:
            if isinstance(field.dataType, StringType):
                value = F.when(~value.isin(*MISSING), value)
            elif isinstance(field.dataType, (DoubleType, FloatType)):
                value = F.when(~F.isnan(value), value)
        out.append(value.alias(field.name))
    return df.select(*out)


def infer_types(df: DataFrame) -> DataFrame:
    """Type string columns by their values: bigint, double, boolean or string.

    One aggregation decides for all columns.  A column of integers with missing
    values becomes double.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not names:
        return df

    def all_match(test: Column) -> Column:
        return F.coalesce(F.bool_and(test), F.lit(False))

    checks = []
    for i, name in enumerate(names):
        value = F.col(f"`{name}`")
        checks += [
            all_match(F.when(value.isNotNull(), value.rlike(_INTEGER) & F.trim(value).try_cast("bigint").isNotNull())).alias(f"i{i}"),
            all_match(value.rlike(_NUMBER)).alias(f"d{i}"),
            all_match(value.isin(*_BOOLEAN)).alias(f"b{i}"),
            (F.count(value) < F.count("*")).alias(f"m{i}"),
        ]
    verdict = df.agg(*checks).first()
    types = {}
    for i, name in enumerate(names):
        if verdict[f"i{i}"] and not verdict[f"m{i}"]:
            types[name] = "bigint"
        elif verdict[f"d{i}"]:
            types[name] = "double"
        elif verdict[f"b{i}"] and not verdict[f"m{i}"]:
            types[name] = "boolean"
    return df.select(
        *[
            F.trim(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _read_csv(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rows = missing_to_null(read_csv_splits(spark, path, schema))
    return rows if schema is not None else infer_types(rows)


def _read_json(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return missing_to_null((reader.schema(schema) if schema is not None else reader).json(path))


def _read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return missing_to_null(reader.json(path))


def _read_parquet(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


# suffix -> reader; callers may add their own
READERS = {".csv": _read_csv, ".json": _read_json, ".jsonl": _read_json_lines, ".parquet": _read_parquet}


def load_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """A table by its file suffix (case-sensitive) or ``fmt``.

    CSV has a header and gets its types from the values unless a schema is given,
    which saves a pass at scale.  ``.json`` is an array of records, ``.jsonl`` one
    record per line.
    """
    suffix = f".{fmt}" if fmt else next((s for s in READERS if path.rstrip("/").endswith(s)), "")
    if suffix not in READERS:
        raise ValueError(f"unsupported file type: {path}")
    return READERS[suffix](spark, path, schema)


def load_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(source, path, text): one row per file, source being its base name; an empty folder is an error."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    if not files.inputFiles():
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    return files.select(
        F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_urls(lines: DataFrame, line: str = "value") -> DataFrame:
    """(url, depth) of seed lines ``url,depth``; a depth that is not all digits means no limit.

    A line with fewer than two fields raises when it is read.
    """
    parts = F.split(F.trim(line), ",", -1)
    depth = F.trim(parts[1])
    checked = F.when(F.size(parts) >= 2, F.trim(parts[0])).otherwise(
        F.raise_error(F.concat(F.lit("invalid line: "), F.col(line)))
    )
    return lines.select(checked.alias("url"), F.when(depth.rlike(r"^\d+\z"), depth.cast("int")).alias("depth"))


def load_urls(spark: SparkSession, path: str) -> DataFrame:
    return read_urls(spark.read.text(path))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def output_names(df: DataFrame, source: str, kind: str, sheet: str | None = None) -> DataFrame:
    """Add ``out_name``: the source's base name with the suffix of its parser.

    ``kind``: text (``_cleaned``), pdf (``_parsed``), excel (``_{sheet}``) or other (plain).
    """
    stem = F.regexp_replace(base_name(source), r"(?<=.)\.[^.]*\z", "")
    if kind == "text":
        name = F.concat(stem, F.lit(CLEANED))
    elif kind == "pdf":
        name = F.concat(stem, F.lit(PARSED))
    elif kind == "excel":
        name = F.concat(stem, F.lit("_"), F.col(sheet), F.lit(".txt"))
    else:
        name = F.concat(stem, F.lit(".txt"))
    return df.withColumn("out_name", name)


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents as a table ``(source, out_name, part, text)``."""
    df.write.mode(mode).parquet(path)


def write_by_class(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per ``file_class``, so that a reader of one class prunes the others."""
    df.write.mode(mode).partitionBy("file_class").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the stored chunks."""
    chunks.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Replace the stored vectors: the old ones are dropped first."""
    vectors.write.mode("overwrite").parquet(path)


def write_keywords(records: DataFrame, reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The JSON records and the text reports, side by side."""
    write_json(records, f"{path}/records", mode)
    reports.write.mode(mode).parquet(f"{path}/reports")
