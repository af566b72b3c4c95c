"""k-means and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ml.prep import SEED, fit_vectorizer

CLUSTERS = 3  # fixed default
COMPONENTS = 2  # fixed default


def fit_kmeans(vectors: DataFrame, k: int = CLUSTERS, features: str = "features"):
    return KMeans(k=k, seed=SEED, featuresCol=features, predictionCol="cluster").fit(vectors)


def kmeans(df: DataFrame, columns: Sequence[str], k: int = CLUSTERS, scale: bool = True) -> tuple[DataFrame, PipelineModel]:
    """``df`` with features and cluster, and the fitted pipeline."""
    vectorizer = fit_vectorizer(df, columns, scale)
    model = fit_kmeans(vectorizer.transform(df), k)
    pipeline = PipelineModel(stages=[*vectorizer.stages, model])
    out = pipeline.transform(df)
    return out.select(*df.columns, "features", "cluster"), pipeline


def pca(
    df: DataFrame, columns: Sequence[str], components: int = COMPONENTS, scale: bool = True
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """(rows with ``coordinates ARRAY``, (component, ratio) rows, fitted pipeline).

    Rows are centred even without scaling, as Spark's projection does not centre.
    The sign of a component is arbitrary.
    """
    rows = df.count()
    components = min(components, rows, len(columns))
    if scale:
        vectorizer = fit_vectorizer(df, columns, True)
    else:
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        vectorizer = Pipeline(
            stages=[
                VectorAssembler(inputCols=list(columns), outputCol="_numeric"),
                StandardScaler(inputCol="_numeric", outputCol="features", withMean=True, withStd=False),
            ]
        ).fit(df)
    model = PCA(k=components, inputCol="features", outputCol="_pca").fit(vectorizer.transform(df))
    pipeline = PipelineModel(stages=[*vectorizer.stages, model])
    coordinates = pipeline.transform(df).select(*df.columns, vector_to_array("_pca").alias("coordinates"))
    ratios = df.sparkSession.createDataFrame(
        [(i, float(r)) for i, r in enumerate(model.explainedVariance)], "component int, explained_variance_ratio double"
    )
    return coordinates, ratios, pipeline
