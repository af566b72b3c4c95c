"""Exact vector retrieval, chunk-graph expansion and hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.dedupe import dedupe_keep_first
from paperloom.plans.blocks import meet_in_blocks

# --- fixed values: must equal the expected output ---------------------------------
DOT_TOP_K = 5
TOP_K = 7
CONTEXT_SEPARATOR = "\n\n"
EMPTY_COLLECTION = "The document collection is empty. Please run the ingestion script first."
NO_HITS = "I could not find any relevant information in the documents to answer your question."
# -----------------------------------------------------------------------------------

MEETING_CELLS = 1 << 20  # scores that a task holds at once
GROUP = 16  # columns whose maximum stands for them when the k-th best score is bounded
MANY_TIES = 8  # beyond this many times ``k`` candidates a query is settled by itself

#: (queries, vectors) -> scores of all pairs; how far they may be from the exact ones, per query; exact scores of single pairs
Scorer = tuple[
    Callable[[np.ndarray, np.ndarray], np.ndarray],
    Callable[[np.ndarray, np.ndarray], np.ndarray],
    Callable[[np.ndarray, np.ndarray], np.ndarray] | None,
]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _dot(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return queries @ vectors.T


def _near(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One minus the expanded square; its cancellation is bounded by ``_near_error``."""
    squares = np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->i", vectors, vectors)
    return 1.0 - (squares - 2.0 * (queries @ vectors.T))


def _near_error(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    reach = np.sqrt(np.einsum("ij,ij->i", queries, queries)) + np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())
    return (4 * queries.shape[1] + 32) * np.finfo(float).eps * (1.0 + reach**2)


def _one_minus_l2(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    delta = vectors - queries  # differences, not the expanded square: no cancellation
    return 1.0 - np.einsum("ij,ij->i", delta, delta)


_BY_DOT: Scorer = _dot, lambda queries, vectors: np.zeros(len(queries)), None
_BY_L2: Scorer = _near, _near_error, _one_minus_l2


def _kth_at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that at least ``k`` scores reach: the k-th largest maximum over groups of columns."""
    width = scores.shape[1] // GROUP
    if width > GROUP * k:
        maxima = scores[:, : width * GROUP].reshape(len(scores), GROUP, width).max(axis=1)
        scores = np.concatenate([maxima, scores[:, width * GROUP :]], axis=1)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, of equal ones the first places; NaN is never one."""
    known = np.flatnonzero(~np.isnan(scores))
    scores = scores[known]
    if len(known) <= k:
        return known
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, tied = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
    return known[np.concatenate([above, tied[: k - len(above)]])]


def best_pairs(queries: np.ndarray, vectors: np.ndarray, scorer: Scorer, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the ``k`` best vectors per query, as places, and a few more; a tie goes to the earlier vector.

    All pairs are scored in slices of ``MEETING_CELLS``; what the quick scores leave open is scored exactly.  Scores
    are rounded, so that equal vectors tie whatever their place in a block.
    """
    score_all, error, exact = scorer
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, MEETING_CELLS // max(1, len(vectors)))
    finite = bool(np.isfinite(vectors).all())
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        with np.errstate(invalid="ignore", over="ignore"):
            scores = score_all(part, vectors)
        if len(vectors) <= k:
            q, v = np.indices(scores.shape).reshape(2, -1)
            alone = np.zeros(0, int)
        else:
            with np.errstate(invalid="ignore", over="ignore"):
                floor = _kth_at_least(scores, k)
                slack = 2 * error(part, vectors) + 2e-12 + 4 * np.finfo(float).eps * np.abs(floor)
                q, v = np.nonzero(scores >= (floor - slack)[:, None])
            # many ties, or no bound on the error: the whole row is scored exactly
            many = (np.bincount(q, minlength=len(part)) > MANY_TIES * k) | ~np.isfinite(floor + slack)
            if not finite:
                many[:] = True
            q, v, alone = q[~many[q]], v[~many[q]], np.flatnonzero(many)
        with np.errstate(invalid="ignore", over="ignore"):
            value = scores[q, v] if exact is None else exact(part[q], vectors[v])
            found.append((q + at, v, np.round(value, 12)))
            for row in alone:
                whole = np.round(scores[row] if exact is None else exact(part[row], vectors), 12)
                chosen = _first_k(whole, k)
                found.append((np.full(len(chosen), row + at), chosen, whole[chosen]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _top_k(
    queries: DataFrame,
    vectors: DataFrame,
    scorer: Scorer,
    k: int,
    query_id: str,
    vector_id: str,
    embedding: str,
    max_broadcast_rows: int,
    rows_per_block: int,
) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    query_type = queries.schema[query_id].dataType.simpleString()
    # no NULL reaches the scorer
    lhs = vectors.select(F.col(vector_id).alias("_vid"), F.col(embedding).alias("_v")).where("_v is not null")
    rhs = queries.select(F.col(query_id).alias("_qid"), F.col(embedding).alias("_q")).where("_q is not null")

    def best_of(hits: pd.DataFrame) -> pd.DataFrame:
        ordered = hits.sort_values(["_qid", "relevance", "_vid"], ascending=[True, False, True])
        return ordered.groupby("_qid", sort=False).head(k)

    def best_of_block(block: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_vid")  # a tie goes to the smaller id
        q, v, scores = best_pairs(_matrix(probes["_q"]), _matrix(block["_v"]), scorer, k)
        ids, qids = block["_vid"].to_numpy(), probes["_qid"].to_numpy()
        return best_of(pd.DataFrame({"_qid": qids[q], "_vid": ids[v], "relevance": scores}))

    schema = f"_qid {query_type}, _vid {types[vector_id]}, relevance double"
    partial = meet_in_blocks(lhs, rhs, "_vid", "_qid", best_of_block, schema, max_broadcast_rows, rows_per_block, best_of)
    order = Window.partitionBy("_qid").orderBy(F.desc("relevance"), "_vid")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("_qid").alias("query_id"), F.col("_vid").alias(vector_id), "relevance", "rank")
    )


def topk_dot(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = DOT_TOP_K,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
    max_broadcast_rows: int = 4_096,
    rows_per_block: int = 16_384,
) -> DataFrame:
    """The ``k`` vectors with the largest dot product per query: query_id, vector id, relevance, rank.

    Each task scores blocks of vectors against the queries with matrix products of
    bounded size and keeps ``k`` rows per query, so the shuffle carries partial top lists only.
    """
    return _top_k(queries, vectors, _BY_DOT, k, query_id, vector_id, embedding, max_broadcast_rows, rows_per_block)


def topk_l2(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
    max_broadcast_rows: int = 4_096,
    rows_per_block: int = 16_384,
) -> DataFrame:
    """The ``k`` nearest vectors by squared Euclidean distance; relevance is one minus it."""
    return _top_k(
        queries, vectors, _BY_L2, k, query_id, vector_id, embedding, max_broadcast_rows, rows_per_block
    )


def expand_neighbors(nodes: DataFrame, edges: DataFrame, node: str = "node", group: Sequence[str] = ("query_id",)) -> DataFrame:
    """The nodes of each group together with their graph neighbours: group, node."""
    group = list(group)
    top = nodes.select(*group, F.col(node).alias(node))
    both = edges.select(F.col("src").alias(node), F.col("dst").alias("_other")).unionByName(
        edges.select(F.col("dst").alias(node), F.col("src").alias("_other"))
    )
    # one pass over the nodes, which may come from a costly search
    met = top.join(both.withColumn("_met", F.lit(True)), node, "left")
    reached = F.when(F.col("_met"), F.array(node, "_other")).otherwise(F.array(node))
    return met.select(*group, F.explode(reached).alias(node)).distinct()


def graph_retrieve(
    queries: DataFrame,
    vectors: DataFrame,
    edges: DataFrame,
    k: int = DOT_TOP_K,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
    keep_expanded: bool = False,
) -> DataFrame:
    """Top ``k`` by dot product, widened by graph neighbours, ranked by similarity, cut to ``k``.

    On a path graph a neighbour never beats the k-th hit, so the cut leaves the plain
    top ``k``; ``keep_expanded`` returns the widened set instead.
    """
    hits = topk_dot(queries, vectors, k, query_id, vector_id, embedding)
    nodes = expand_neighbors(hits.withColumnRenamed(vector_id, "node"), edges)
    probes = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("_q"))
    items = vectors.select(F.col(vector_id).alias("node"), F.col(embedding).alias("_v"))
    product = F.aggregate(
        F.zip_with("_q", "_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b
    )
    scored = nodes.join(items, "node").join(probes, "query_id").select("query_id", "node", product.alias("relevance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "node"))
    ranked = scored.withColumn("rank", rank)
    ranked = ranked if keep_expanded else ranked.where(F.col("rank") <= k)
    return ranked.withColumnRenamed("node", vector_id)


def hybrid_search(
    queries: DataFrame,
    vectors: DataFrame,
    texts: DataFrame,
    edges: DataFrame | None = None,
    k: int = TOP_K,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Graph hits, then vector hits; a repeated text keeps its first hit; top ``k`` by relevance.

    ``texts`` holds ``(vector_id, text)`` and optionally ``metadata``.
    """
    if edges is None:
        graph = topk_dot(queries, vectors, k, query_id, vector_id, embedding)
    else:
        graph = graph_retrieve(queries, vectors, edges, k, query_id, vector_id, embedding)
    near = topk_l2(queries, vectors, k, query_id, vector_id, embedding)
    hits = graph.withColumn("source_order", F.lit(0)).unionByName(near.withColumn("source_order", F.lit(1)))
    hits = hits.withColumnRenamed("rank", "hit_rank").join(texts, vector_id)
    kept = dedupe_keep_first(hits, ["query_id", "text"], ["source_order", "hit_rank"])
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "source_order", "hit_rank")
    return (
        kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("source_order", "hit_rank")
    )


def build_context(queries: DataFrame, hits: DataFrame, collection: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One context per query: hit texts in rank order, or a fixed message when there is none."""
    message = NO_HITS if collection.take(1) else EMPTY_COLLECTION
    texts = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]), CONTEXT_SEPARATOR
        ).alias("context")
    )
    asked = queries.select(F.col(query_id).alias("query_id"))
    return asked.join(texts, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(message)).alias("context")
    )


def as_struct_hits(hits: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """The hit shape ``(query_id, text, metadata STRUCT, relevance)``."""
    return hits.select("query_id", "text", F.struct(*metadata).alias("metadata"), "relevance")

