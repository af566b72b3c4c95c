"""Text to dense vectors: hashed term frequencies, weighted and normalised.

A stand-in for a pretrained sentence model, whose weights are not available
here.  Retrieval takes any vector column, so another model can be plugged in.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame


def fit_embedder(corpus: DataFrame, text: str = "text", dimensions: int = 256) -> PipelineModel:
    """Fit the term weights on a corpus; apply the model to chunks and to queries alike."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\W+"),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
        ]
    ).fit(corpus)


def embed(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``embedding ARRAY<FLOAT>``."""
    out = model.transform(df).withColumn("embedding", vector_to_array("_unit", "float32"))
    return out.drop("_tokens", "_tf", "_tfidf", "_unit")
