"""Compositions of the operators, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import clean_lines
from paperloom.operators.aggregate import aggregate
from paperloom.operators.chunks import chunk_fixed, chunk_recursive, next_chunk_edges
from paperloom.operators.embed import embed, fit_embedder
from paperloom.operators.retrieve import build_context, hybrid_search
from paperloom.plans.materialize import materialize


def chunk_profile(documents: DataFrame, key: str = "doc_id", by: str = "lang") -> DataFrame:
    """Clean, cut into fixed chunks, link the chunks, and profile them per language."""
    clean = documents.select(key, by, clean_lines(F.col("text")).alias("text"))
    chunks = chunk_fixed(clean, "text", [key, by])
    edges = next_chunk_edges(chunks, key, contiguous=True, keep=[by])
    sizes = chunks.withColumn("chars", F.length("text"))
    profile = aggregate(
        sizes, [by], {"chunk_id": ["count", "max"], "chars": ["sum", "mean"], key: ["nunique"]}, sort=False
    )
    links = edges.groupBy(by).agg(F.count("*").alias("edges"))
    return profile.join(links, by, "left").withColumn("edges", F.coalesce("edges", F.lit(0))).orderBy(by)


def answer_contexts(
    documents: DataFrame, questions: DataFrame, key: str = "doc_id", question_id: str = "query_id", k: int = 7
) -> DataFrame:
    """Documents -> recursive chunks -> vectors -> hybrid search -> one context per question.

    ``questions``: question_id, text.
    """
    # cut and embedded once: the fit, two searches and the lookup of the texts read what was written
    chunks = materialize(chunk_recursive(documents, "text", [key]), "chunks")
    model = fit_embedder(chunks)
    nodes = embed(chunks, model).select(F.concat_ws("#", key, "chunk_id").alias("node"), "embedding")
    vectors = materialize(nodes, "vectors")
    asked = embed(questions.select(F.col(question_id).alias("query_id"), "text"), model)
    texts = chunks.select(F.concat_ws("#", key, "chunk_id").alias("node"), "text")
    hits = hybrid_search(asked, vectors, texts, None, k, vector_id="node")
    return build_context(asked, hits, chunks)
