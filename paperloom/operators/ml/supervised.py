"""Regression and classification with a cross-validated parameter grid."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from paperloom.operators.impute import cardinality_guard, impute
from paperloom.operators.ml.metrics import classification_report, regression_metrics
from paperloom.operators.ml.prep import (
    FOLDS,
    TEST_SIZE,
    add_folds,
    fit_preprocessor,
    select_features,
    split_flags,
)
from paperloom.operators.ml.trees import search_boosted, search_forest
from paperloom.plans.materialize import discard, ensure_checkpointing, materialize

# --- fixed values: must equal the expected output ---------------------------------
PENALTIES = [0.01, 0.1, 1, 10, 100]
GRIDS: dict[tuple[str, str], dict[str, list]] = {
    ("regression", "linear"): {"fit_intercept": [True, False]},
    ("regression", "ridge"): {"alpha": PENALTIES},
    ("regression", "lasso"): {"alpha": PENALTIES},
    ("regression", "xgboost"): {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1]},
    ("regression", "randomforest"): {"n_estimators": [100, 200], "max_depth": [None, 10, 20]},
    ("classification", "logistic"): {"C": [0.01, 0.1, 1, 10]},
    ("classification", "xgboost"): {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1]},
    ("classification", "randomforest"): {"n_estimators": [100, 200], "max_depth": [None, 10, 20]},
}
LASSO_ITERATIONS = 10_000
LOGISTIC_ITERATIONS = 2_000
# -----------------------------------------------------------------------------------

COLS = {"featuresCol": "features", "labelCol": "label"}


@dataclass(frozen=True)
class TrainingShape:
    """What a penalty must be rescaled by; measured on the rows of each fit."""

    rows: int
    label_deviation: float
    classes: int


def training_shapes(train: DataFrame, folds: int = 0) -> list[TrainingShape]:
    """The shape of the rows outside each fold, and last that of all rows, from one aggregation."""
    label = F.col("label")
    parts = [F.when(F.col("fold") != fold, label) for fold in range(folds)] + [label]
    stats = train.agg(F.array(*[F.struct(F.count(p), F.stddev_pop(p), F.max(p)) for p in parts])).first()[0]
    return [TrainingShape(n, deviation or 1.0, int(top or 0) + 1) for n, deviation, top in stats]


def linear(p: Mapping, shape: TrainingShape) -> Estimator:
    return LinearRegression(regParam=0.0, fitIntercept=p["fit_intercept"], **COLS)


def ridge(p: Mapping, shape: TrainingShape) -> Estimator:
    """Penalty ``alpha * |w|^2`` on the summed squared error.

    Spark's penalty acts on the mean error of the label divided by its (population)
    deviation, hence the factor.
    """
    reg = p["alpha"] * shape.label_deviation / shape.rows
    return LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=reg, **COLS)


def lasso(p: Mapping, shape: TrainingShape) -> Estimator:
    return LinearRegression(
        elasticNetParam=1.0, standardization=False, regParam=p["alpha"], maxIter=LASSO_ITERATIONS, tol=1e-9, **COLS
    )


def logistic(p: Mapping, shape: TrainingShape) -> Estimator:
    """Inverse penalty ``C`` on the summed loss is ``1 / (C n)`` on the mean loss."""
    return LogisticRegression(
        standardization=False, regParam=1.0 / (p["C"] * shape.rows), maxIter=LOGISTIC_ITERATIONS, tol=1e-7, **COLS
    )


Builder = Callable[[Mapping, TrainingShape], Estimator]
TreeSearch = Callable[[DataFrame, str, Sequence[Mapping], int], tuple[list[float], Model]]
#: a builder fits one point of a grid; a search of trees fits the points of a grid together
MODELS: dict[tuple[str, str], Builder | TreeSearch] = {
    ("regression", "linear"): linear,
    ("regression", "ridge"): ridge,
    ("regression", "lasso"): lasso,
    ("regression", "xgboost"): search_boosted,
    ("regression", "randomforest"): search_forest,
    ("classification", "logistic"): logistic,
    ("classification", "xgboost"): search_boosted,
    ("classification", "randomforest"): search_forest,
}


def expand_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def _score(module: str, predictions: DataFrame) -> float:
    """Negative RMSE or accuracy: larger is better."""
    if module == "regression":
        gap = F.col("prediction") - F.col("label")
        return -(predictions.agg(F.sqrt(F.avg(gap * gap))).first()[0] or 0.0)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predictions.agg(F.avg(hit)).first()[0] or 0.0


@dataclass
class Search:
    best_params: dict
    scores: DataFrame
    model: Model


def grid_search(
    train: DataFrame,
    module: str,
    build: Builder,
    candidates: Sequence[Mapping],
    folds: int = FOLDS,
    parallelism: int = 4,
) -> Search:
    """Score each candidate by its mean over the folds; refit the best on all rows.

    ``train``: features, label, fold.  It should be a written or cached table, as
    every fit reads it.  The driver only schedules fits; it never sees rows.
    """
    *shapes, whole = training_shapes(train, folds)

    def run(job: tuple[int, int]) -> float:
        candidate, fold = job
        model = build(candidates[candidate], shapes[fold]).fit(train.where(F.col("fold") != fold))
        return _score(module, model.transform(train.where(F.col("fold") == fold)))

    jobs = [(c, f) for c in range(len(candidates)) for f in range(folds)]
    with ThreadPool(parallelism) as pool:
        results = pool.map(run, jobs, chunksize=1)
    means = [sum(results[c * folds : (c + 1) * folds]) / folds for c in range(len(candidates))]
    best, scores = _ranked(train, candidates, means)
    return Search(dict(candidates[best]), scores, build(candidates[best], whole).fit(train))


def _ranked(train: DataFrame, candidates: Sequence[Mapping], means: Sequence[float]) -> tuple[int, DataFrame]:
    """The place of the first best candidate, and all scores."""
    best = max(range(len(candidates)), key=lambda c: (means[c], -c))
    rows = [(str(dict(candidates[c])), float(means[c]), c == best) for c in range(len(candidates))]
    return best, train.sparkSession.createDataFrame(rows, "params string, mean_score double, best boolean")


@dataclass
class Fitted:
    """A fitted run: tables stay DataFrames."""

    best_params: dict
    scores: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    model: PipelineModel


def fit_supervised(
    df: DataFrame,
    id_col: str,
    target: str | None = None,
    module: str = "regression",
    model_type: str = "linear",
    features: Sequence[str] | None = None,
    test_size: float = TEST_SIZE,
    scale: bool = True,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = FOLDS,
    parallelism: int = 4,
) -> Fitted:
    """Impute, check, split, encode, scale, search, refit, predict and measure.

    ``target`` defaults to the last column.  ``id_col`` names the rows: it drives the
    split and the folds and is not a feature unless listed.  Preprocessing is fitted
    once on the training rows, before cross-validation.
    """
    ensure_checkpointing(df.sparkSession)
    target = target or df.columns[-1]
    if (module, model_type) not in MODELS:
        raise ValueError(f"no model {model_type!r} for {module!r}")
    features = list(features or [c for c in select_features(df, target) if c != id_col])
    stratify = target if module == "classification" else None
    rows = df.select(id_col, *features, target)
    has_holes = bool(rows.where(F.col(target).isNull()).take(1))  # a whole target keeps its type
    filled = materialize(impute(rows, [*features, target] if has_holes else features), "filled")
    cardinality_guard(filled, target, module)
    flagged = materialize(split_flags(filled, id_col, stratify, test_size), "split")
    discard(filled)
    train, test = flagged.where(~F.col("is_test")), flagged.where("is_test")

    encoder = None
    numeric_target = isinstance(flagged.schema[target].dataType, NumericType)
    if module == "classification":
        labelled = train.withColumn("_target", F.col(target).cast("string"))
        if numeric_target:  # order classes by value, not by spelling
            values = [r[0] for r in train.select(target).distinct().orderBy(target).collect()]  # at most 20
            encoder = StringIndexerModel.from_labels([str(v) for v in values], "_target", "label", handleInvalid="keep")
        else:
            encoder = StringIndexer(
                inputCol="_target", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"
            ).fit(labelled)
    preprocessor = fit_preprocessor(train, features, scale)

    def prepared(rows: DataFrame) -> DataFrame:
        if encoder is None:
            rows = rows.withColumn("label", F.col(target).cast("double"))
        else:
            rows = encoder.transform(rows.withColumn("_target", F.col(target).cast("string")))
        return preprocessor.transform(rows).select("features", "label", "fold", F.xxhash64(id_col).alias("row"))

    table = prepared(add_folds(train, id_col, stratify, folds))
    build = MODELS[module, model_type]
    candidates = expand_grid(grid if grid is not None else GRIDS[module, model_type])
    if build in (search_boosted, search_forest):  # they write the rows as bytes
        means, fitted = build(table, module, candidates, folds)
        best, scores = _ranked(table, candidates, means)
        search = Search(dict(candidates[best]), scores, fitted)
    else:
        search = grid_search(materialize(table, "train"), module, build, candidates, folds, parallelism)

    stages = [*preprocessor.stages, search.model]
    if encoder is not None:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted_label", labels=encoder.labels))
    model = PipelineModel(stages=stages)
    scored = materialize(model.transform(test).select(
        F.col(id_col).alias("id"),
        F.col(target).alias("actual"),
        (F.col("prediction") if encoder is None else F.col("predicted_label").cast(flagged.schema[target].dataType)).alias("predicted"),
    ), "predictions")
    metrics = regression_metrics(scored) if module == "regression" else classification_report(scored)
    return Fitted(search.best_params, search.scores, metrics, scored, model)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
