"""Feature selection, splits, folds, scaling and encoding."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from paperloom.plans.joins import lookup_join
from paperloom.plans.materialize import materialize
from paperloom.plans.number import number_rows
from paperloom.plans.orderstats import order_statistics

# --- fixed values: must equal the expected output ---------------------------------
TEST_SIZE = 0.2
SEED = 42
FOLDS = 5
# -----------------------------------------------------------------------------------


def select_features(df: DataFrame, target: str | None = None, supervised: bool = True) -> list[str]:
    """Supervised: every column but the target (default: the last).  Unsupervised: the numeric columns."""
    if not supervised:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    target = target or df.columns[-1]
    return [c for c in df.columns if c != target]


def _labelled(df: DataFrame, label: str | None) -> DataFrame:
    """Add ``_label``, a text that equals itself also where the label is NULL; rows without a label are a class."""
    if not label:
        return df
    return df.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-")))


def split_flags(
    df: DataFrame, id_col: str, label: str | None = None, test_size: float = TEST_SIZE, seed: int = SEED, hot_rows: int = 100_000
) -> DataFrame:
    """Add ``is_test``: the ``ceil(test_size * n)`` rows of each label with the smallest hash of the id.

    Repeatable on any partitioning.  The cut per label is an order statistic of the
    hash, so a label with most of the rows is never sorted in one task.
    """
    keys = ["_label"] if label else []
    hashed = _labelled(df, label).withColumn("_hash", F.xxhash64(id_col, F.lit(seed)))
    cuts = order_statistics(
        hashed, keys, "_hash", {"_cut": (test_size, lambda n: F.ceil(n * F.lit(test_size)) - 1)}, hot_rows=hot_rows
    ).select(*keys, "_cut")
    if not keys:
        return hashed.withColumn("is_test", F.col("_hash") <= cuts.scalar()).select(*df.columns, "is_test")
    joined = lookup_join(hashed, materialize(cuts, "cuts"), keys)
    return joined.withColumn("is_test", F.col("_hash") <= F.col("_cut")).select(*df.columns, "is_test")


def train_test_split(
    df: DataFrame, id_col: str, label: str | None = None, test_size: float = TEST_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    flagged = split_flags(df, id_col, label, test_size, seed)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


def add_folds(df: DataFrame, order: str, label: str | None = None, folds: int = FOLDS, hot_rows: int = 100_000) -> DataFrame:
    """Add ``fold`` 0..folds-1: contiguous runs in ``order`` (unique), per label when stratified."""
    keys = ["_label"] if label else []
    rows = _labelled(df, label)

    def last_rank(i: int):
        return lambda n: (i + 1) * F.floor(n / folds) + F.least(F.lit(i + 1), n % folds) - 1

    points = {f"_end{i}": ((i + 1) / folds, last_rank(i)) for i in range(folds - 1)}
    ends = order_statistics(rows, keys, order, points, hot_rows=hot_rows).select(*keys, F.array(*points).alias("_ends"))
    if keys:
        rows = lookup_join(rows, materialize(ends, "folds"), keys)
    else:
        rows = rows.withColumn("_ends", ends.scalar())
    fold = F.size(F.filter("_ends", lambda e: F.col(order) > e))
    return rows.withColumn("fold", fold).select(*df.columns, "fold")


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """(target, code): distinct values in ascending order, 0..n-1; one row per class."""
    classes = df.select(target).where(F.col(target).isNotNull()).distinct()
    return number_rows(classes.orderBy(target), "code")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by z-scores with the population standard deviation; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    moments = stats.select(F.struct(*stats.columns)).scalar()
    scaled = {
        c: (F.col(c) - moments[f"m_{c}"]) / F.when(moments[f"s_{c}"] == 0, 1.0).otherwise(moments[f"s_{c}"])
        for c in columns
    }
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def scaler_stages(input_col: str, output_col: str, rows: int, width: int) -> list:
    """Stages for z-scores with the population deviation; Spark's scaler divides by the sample one."""
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    return [
        StandardScaler(inputCol=input_col, outputCol=f"{output_col}_sample", withMean=True, withStd=True),
        ElementwiseProduct(
            inputCol=f"{output_col}_sample", outputCol=output_col, scalingVec=Vectors.dense([factor] * width)
        ),
    ]


def fit_preprocessor(train: DataFrame, features: Sequence[str], scale: bool = True, output: str = "features") -> PipelineModel:
    """Fit scaling and one-hot encoding on the training rows.

    A category unseen in training becomes all zeros: the index kept for invalid
    values is the one the encoder drops.
    """
    numeric = [c for c in features if isinstance(train.schema[c].dataType, (NumericType, BooleanType))]
    text = [c for c in features if isinstance(train.schema[c].dataType, StringType)]
    stages, parts = [], []
    if numeric:
        stages.append(VectorAssembler(inputCols=numeric, outputCol="_numeric"))
        parts.append("_numeric")
        if scale:
            stages += scaler_stages("_numeric", "_scaled", train.count(), len(numeric))
            parts = ["_scaled"]
    if text:
        indexed, encoded = [f"_ix_{c}" for c in text], [f"_hot_{c}" for c in text]
        stages.append(
            StringIndexer(inputCols=text, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True))
        parts += encoded
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return Pipeline(stages=stages).fit(train)


def fit_vectorizer(df: DataFrame, columns: Sequence[str], scale: bool = True, output: str = "features") -> PipelineModel:
    """Numeric columns to one (scaled) vector for the unsupervised models."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_numeric" if scale else output)
    scaling = scaler_stages("_numeric", output, df.count(), len(columns)) if scale else []
    return Pipeline(stages=[assembler, *scaling]).fit(df)
