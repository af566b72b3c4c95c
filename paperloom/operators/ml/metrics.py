"""Model quality in long form: rows ``(metric, label, value)``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.blocks import meet_in_blocks
from paperloom.plans.joins import lookup_join
from paperloom.plans.materialize import materialize

MEETING_CELLS = 1 << 20  # distances that a task holds at once
CANCELLATION = 1e-4  # squared distances below this share of the squared lengths are taken from differences
PAIRS = 1 << 14


def _long(wide: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    rows = [
        F.struct(F.lit(name).alias("metric"), F.lit("all").alias("label"), value.cast("double").alias("value"))
        for name, value in metrics.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """RMSE, MAE and R2 from one aggregation."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = df.agg(
        F.avg((a - p) * (a - p)).alias("mse"), F.avg(F.abs(a - p)).alias("mae"), F.var_pop(a).alias("variance")
    )
    return _long(
        sums,
        {"RMSE": F.sqrt("mse"), "MAE": F.col("mae"), "R2": 1 - F.col("mse") / F.nullif(F.col("variance"), F.lit(0.0))},
    )


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy; precision, recall, F1 and support per label; macro and weighted averages; 0 on zero division."""
    cells = df.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"), hit.alias("tp")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"), F.lit(0).cast("long").alias("tp")),
            )
        )
    )
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("tp").alias("tp"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    precision, recall = ratio(F.col("tp"), F.col("chosen")), ratio(F.col("tp"), F.col("support"))
    per_label = sums.select("label", "support", "tp", precision.alias("precision"), recall.alias("recall"))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    per_label = per_label.withColumn("f1_score", f1)
    names = ["precision", "recall", "f1_score"]
    total = F.sum("support")
    averages = per_label.agg(
        (F.sum("tp") / total).alias("accuracy"),
        total.alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in names],
    )

    def entry(metric: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value"))

    rows = per_label.select(
        F.inline(F.array(*[entry(m, F.col("label"), F.col(m)) for m in [*names, "support"]]))
    )
    summary = [entry("accuracy", F.lit("all"), F.col("accuracy"))]
    for kind in ("macro", "weighted"):
        label = F.lit(f"{kind} avg")
        summary += [entry(m, label, F.col(f"{kind}_{m}")) for m in names] + [entry("support", label, F.col("support"))]
    return rows.unionByName(averages.select(F.inline(F.array(*summary))))


def _as_vector(df: DataFrame, features: str) -> Column:
    return F.col(features) if isinstance(df.schema[features].dataType, VectorUDT) else array_to_vector(
        F.col(features).cast("array<double>")
    )


def _as_array(df: DataFrame, features: str) -> Column:
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast(
        "array<double>"
    )


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _centroids(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """cluster, n, center: one row per cluster, written once."""
    vectors = df.select(F.col(cluster).alias("cluster"), _as_vector(df, features).alias("v"))
    means = vectors.groupBy("cluster").agg(F.count("*").alias("n"), Summarizer.mean(F.col("v")).alias("m"))
    return materialize(means.select("cluster", "n", vector_to_array("m").alias("center")), "centroids")


def _with_distance(df: DataFrame, features: str, cluster: str, centers: DataFrame) -> DataFrame:
    rows = df.select(F.col(cluster).alias("cluster"), _as_array(df, features).alias("x"))
    return lookup_join(rows, centers, ["cluster"]).select("cluster", squared_distance("x", "center").alias("d2"))


def davies_bouldin(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of the largest (s_i + s_j) / d_ij; clusters meet in blocks, no pair is emitted."""
    centers = _centroids(df, features, cluster)
    scatter = _with_distance(df, features, cluster, centers).groupBy("cluster").agg(F.avg(F.sqrt("d2")).alias("s"))
    table = materialize(centers.join(scatter, "cluster").select("cluster", "center", "s"), "scatter")

    def worst(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(left["center"].to_numpy()), np.stack(right["center"].to_numpy())
        best = np.full(len(left), -np.inf)
        for i in range(len(left)):
            gap = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
            other = right["cluster"].to_numpy() != left["cluster"].to_numpy()[i]
            spread = right["s"].to_numpy() + left["s"].to_numpy()[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(gap > 0, spread / gap, 0.0)
            if other.any():
                best[i] = ratio[other].max()
        return pd.DataFrame({"cluster": left["cluster"], "r": best})

    kind = table.schema["cluster"].dataType.simpleString()
    partial = meet_in_blocks(table, table, "cluster", "cluster", worst, f"cluster {kind}, r double")
    per_cluster = partial.groupBy("cluster").agg(F.max("r").alias("r"))
    return _long(per_cluster.agg(F.avg("r").alias("db")), {"davies_bouldin_index": F.col("db")})


def calinski_harabasz(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """Between-cluster over within-cluster dispersion, each per degree of freedom."""
    centers = _centroids(df, features, cluster)
    vectors = df.select(_as_vector(df, features).alias("v"))
    overall = vectors.agg(Summarizer.mean(F.col("v")).alias("m")).select(vector_to_array("m")).scalar()
    between = centers.withColumn("overall", overall).agg(
        F.sum(F.col("n") * squared_distance("center", "overall")).alias("b"),
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
    ).select(F.struct("b", "k", "n")).scalar()
    within = _with_distance(df, features, cluster, centers).agg(F.sum("d2").alias("w"), F.max(F.lit(1)).alias("one"))
    b, k, n = between["b"], between["k"], between["n"]
    score = F.when(F.col("w") == 0, 1.0).otherwise((b / (k - 1)) / (F.col("w") / (n - k)))
    return _long(within, {"calinski_harabasz_index": score})


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs: expanded squares, and differences where cancellation would show."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
    d2 = a @ b.T
    d2 *= -2.0
    d2 += squares
    squares *= CANCELLATION
    i, j = np.nonzero(~(d2 > squares))
    for at in range(0, len(i), PAIRS):
        gap = a[i[at : at + PAIRS]] - b[j[at : at + PAIRS]]
        d2[i[at : at + PAIRS], j[at : at + PAIRS]] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(d2, out=d2)


def silhouette(df: DataFrame, id_col: str, features: str = "features", cluster: str = "cluster", **blocks: int) -> DataFrame:
    """Exact mean Euclidean silhouette.

    Needs every distance, so time is quadratic: points meet in blocks and each
    meeting returns one distance sum per point and cluster.  Use
    ``silhouette_squared`` for large tables.
    """
    points = materialize(
        df.select(F.col(id_col).alias("id"), F.col(cluster).alias("own"), _as_array(df, features).alias("x")), "points"
    )

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.iloc[np.argsort(right["own"].to_numpy(), kind="stable")]
        a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        clusters, starts = np.unique(right["own"].to_numpy(), return_index=True)
        totals = np.empty((len(left), len(clusters)))
        step = max(1, MEETING_CELLS // len(right))
        for at in range(0, len(left), step):
            totals[at : at + step] = np.add.reduceat(_distances(a[at : at + step], b), starts, axis=1)
        reach = len(clusters)
        return pd.DataFrame(
            {
                "id": np.repeat(left["id"].to_numpy(), reach),
                "own": np.repeat(left["own"].to_numpy(), reach),
                "other": np.tile(clusters, len(left)),
                "total": totals.ravel(),
            }
        )

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = f"id {kinds['id']}, own {kinds['own']}, other {kinds['own']}, total double"
    partial = meet_in_blocks(points, points, "id", "id", sums, schema, **blocks)
    totals = partial.groupBy("id", "own", "other").agg(F.sum("total").alias("total"))
    sizes = materialize(points.groupBy(F.col("own").alias("other")).agg(F.count("*").alias("n")), "sizes")
    rows = lookup_join(totals, sizes, ["other"])
    mine = F.col("own") == F.col("other")
    per_point = rows.groupBy("id").agg(
        F.max(F.when(mine, F.col("n"))).alias("n"),
        F.max(F.when(mine, F.col("total"))).alias("own_total"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
    )
    a = F.col("own_total") / (F.col("n") - 1)
    value = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce((F.col("b") - a) / F.nullif(F.greatest(a, F.col("b")), F.lit(0.0)), F.lit(0.0))
    )
    return _long(per_point.agg(F.avg(value).alias("s")), {"silhouette_score": F.col("s")})


def silhouette_squared(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """Mean silhouette under squared Euclidean distance, linear in the number of points."""
    rows = df.select(F.col(cluster).cast("double").alias("prediction"), _as_vector(df, features).alias("features"))
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows)
    return df.sparkSession.createDataFrame(
        [("silhouette_squared_euclidean", "all", float(value))], "metric string, label string, value double"
    )


def cluster_count(df: DataFrame, cluster: str = "cluster", noise: int | None = None) -> int:
    labels = df.select(cluster) if noise is None else df.select(cluster).where(F.col(cluster) != noise)
    return labels.distinct().limit(2).count()


ONE_CLUSTER = "All data assigned to one cluster"  # fixed text
MOSTLY_NOISE = "Most points assigned as noise or single cluster"  # fixed text


def clustering_metrics(
    df: DataFrame,
    id_col: str,
    features: str = "features",
    cluster: str = "cluster",
    noise: int | None = None,
    exact_silhouette: bool = False,
) -> DataFrame:
    """The cluster indices, or one ``warning`` row when there are fewer than two clusters."""
    if cluster_count(df, cluster, noise) < 2:
        text = ONE_CLUSTER if noise is None else MOSTLY_NOISE
        return df.sparkSession.createDataFrame([("warning", text, None)], "metric string, label string, value double")
    rows = df if noise is None else df.where(F.col(cluster) != noise)
    sil = silhouette(rows, id_col, features, cluster) if exact_silhouette else silhouette_squared(rows, features, cluster)
    return sil.unionByName(davies_bouldin(rows, features, cluster)).unionByName(
        calinski_harabasz(rows, features, cluster)
    )
