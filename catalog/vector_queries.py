"""Retrieval over the embeddings and over document chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded, table
from paperloom.operators.chunks import chunk_fixed
from paperloom.operators.embed import embed, fit_embedder
from paperloom.operators.retrieve import (
    as_struct_hits,
    build_context,
    expand_neighbors,
    graph_retrieve,
    hybrid_search,
    topk_dot,
    topk_l2,
)
from paperloom.plans.answers import answer_contexts as answer_contexts_of
from paperloom.plans.project import spread

# every vector is asked against every vector
SCORES_SQL = """scores AS (SELECT q.vec_id AS query_id, v.vec_id,
    round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 12) AS dot,
    round(1 - list_sum(list_transform(list_zip(q.embedding, v.embedding),
      lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)), 12) AS near
    FROM embeddings q, embeddings v)"""


def top_sql(score: str, k: int) -> str:
    return f"""(SELECT query_id, vec_id, {score} AS relevance,
        row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, vec_id) AS rank FROM scores QUALIFY rank <= {k})"""


def _vectors(spark, sf):
    return spread(table(spark, sf, "embeddings"))


def _queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _edges(spark, sf):
    """The vectors in id order form a path."""
    ids = table(spark, sf, "embeddings").where("vec_id > 0")
    return ids.select((F.col("vec_id") - 1).alias("src"), F.col("vec_id").alias("dst"))


def _texts(spark, sf):
    """Three neighbouring vectors carry the same text."""
    text = F.concat(F.lit("text "), F.floor(F.col("vec_id") / 3))
    return table(spark, sf, "embeddings").select("vec_id", text.alias("text"), "label")


RANKED = "SELECT query_id, vec_id, round(relevance, 6) AS relevance, CAST(rank AS INTEGER) AS rank FROM "


@query(f"WITH {SCORES_SQL} {RANKED} {top_sql('dot', 5)}", name="topk_dot")
def topk_dot_query(spark, sf):
    return rounded(topk_dot(_queries(spark, sf), _vectors(spark, sf)), 6, "relevance")


@query(f"WITH {SCORES_SQL} {RANKED} {top_sql('dot', 5)}")
def topk_dot_in_blocks(spark, sf):
    """The way taken when the queries are too many to ship to every task."""
    out = topk_dot(_queries(spark, sf), _vectors(spark, sf), max_broadcast_rows=64, rows_per_block=256)
    return rounded(out, 6, "relevance")


@query(f"WITH {SCORES_SQL} {RANKED} {top_sql('near', 7)}", name="topk_l2")
def topk_l2_query(spark, sf):
    return rounded(topk_l2(_queries(spark, sf), _vectors(spark, sf)), 6, "relevance")


EXPANDED_SQL = f"""top AS {top_sql('dot', 5)},
  expanded AS (SELECT DISTINCT query_id, node FROM (SELECT query_id, unnest([vec_id - 1, vec_id, vec_id + 1]) AS node FROM top)
    WHERE node BETWEEN 0 AND (SELECT max(vec_id) FROM embeddings))"""


@query(f"WITH {SCORES_SQL}, {EXPANDED_SQL} SELECT query_id, node FROM expanded", name="expand_neighbors")
def expand_neighbors_query(spark, sf):
    top = topk_dot(_queries(spark, sf), _vectors(spark, sf)).withColumnRenamed("vec_id", "node")
    return expand_neighbors(top, _edges(spark, sf))


@query(f"WITH {SCORES_SQL} {RANKED} {top_sql('dot', 5)}", name="graph_retrieve")
def graph_retrieve_query(spark, sf):
    return rounded(graph_retrieve(_queries(spark, sf), _vectors(spark, sf), _edges(spark, sf)), 6, "relevance")


@query(
    f"""WITH {SCORES_SQL}, {EXPANDED_SQL} SELECT e.query_id, e.node AS vec_id, round(s.dot, 6) AS relevance,
      CAST(row_number() OVER (PARTITION BY e.query_id ORDER BY s.dot DESC, e.node) AS INTEGER) AS rank
    FROM expanded e JOIN scores s ON s.query_id = e.query_id AND s.vec_id = e.node"""
)
def graph_retrieve_expanded(spark, sf):
    out = graph_retrieve(_queries(spark, sf), _vectors(spark, sf), _edges(spark, sf), keep_expanded=True)
    return rounded(out.withColumn("relevance", F.round("relevance", 12)), 6, "relevance")


HYBRID_SQL = f"""hits AS (
    SELECT *, 0 AS src FROM {top_sql('dot', 7)} UNION ALL SELECT *, 1 AS src FROM {top_sql('near', 7)}),
  first AS (SELECT query_id, 'text ' || (vec_id // 3) AS text, arg_min(vec_id, (src, rank)) AS vec_id,
    arg_min(relevance, (src, rank)) AS relevance, min((src, rank)) AS pri FROM hits GROUP BY ALL),
  hybrid AS (SELECT query_id, vec_id, text, relevance,
    row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, pri) AS rank FROM first QUALIFY rank <= 7)"""


@query(
    f"""WITH {SCORES_SQL}, {HYBRID_SQL} SELECT query_id, vec_id, text, round(relevance, 6) AS relevance,
    CAST(rank AS INTEGER) AS rank FROM hybrid""",
    name="hybrid_search",
)
def hybrid_search_query(spark, sf):
    texts = _texts(spark, sf).select("vec_id", "text")
    return rounded(hybrid_search(_queries(spark, sf), _vectors(spark, sf), texts, _edges(spark, sf)), 6, "relevance")


@query(
    f"""WITH {SCORES_SQL}, {HYBRID_SQL} SELECT query_id, text, h.vec_id AS meta_vec_id, e.label AS meta_label,
    round(relevance, 6) AS relevance FROM hybrid h JOIN embeddings e ON e.vec_id = h.vec_id"""
)
def hybrid_hits_with_metadata(spark, sf):
    hits = hybrid_search(_queries(spark, sf), _vectors(spark, sf), _texts(spark, sf))
    shaped = as_struct_hits(hits, ["vec_id", "label"])
    out = shaped.select(
        "query_id", "text", F.col("metadata.vec_id").alias("meta_vec_id"), F.col("metadata.label").alias("meta_label"), "relevance"
    )
    return rounded(out, 6, "relevance")


@query(
    f"""WITH {SCORES_SQL}, {HYBRID_SQL} SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM hybrid GROUP BY query_id""",
    name="build_context",
)
def build_context_query(spark, sf):
    vectors, queries = _vectors(spark, sf), _queries(spark, sf)
    hits = hybrid_search(queries, vectors, _texts(spark, sf).select("vec_id", "text"))
    return build_context(queries, hits, vectors)


@query(name="embed")
def embed_query(spark, sf):
    chunks = chunk_fixed(spread(table(spark, sf, "documents")), "text", ["doc_id"])
    vectors = embed(chunks, fit_embedder(chunks))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return vectors.select("doc_id", "chunk_id", F.size("embedding").alias("dimensions"), F.round(norm, 4).alias("norm"))


@query()
def answer_contexts(spark, sf):
    """The benchmark texts are the questions, the documents the collection."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return answer_contexts_of(spread(table(spark, sf, "documents")), questions)
