import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators.embed import embed, fit_embedder
from paperloom.operators.retrieve import (
    EMPTY_COLLECTION,
    NO_HITS,
    build_context,
    expand_neighbors,
    graph_retrieve,
    hybrid_search,
    topk_dot,
    topk_l2,
)
from paperloom.plans.answers import answer_contexts

VECTORS = [(0, [1.0, 0.0, 0.0], "t0"), (1, [0.9, 0.1, 0.0], "t1"), (2, [3.0, 0.0, 0.0], "t2"), (3, [0.0, 1.0, 0.0], "t0"), (4, [0.0, 0.0, 1.0], "t4"), (5, [1.0, 0.0, 0.0], "t5")]


@pytest.fixture()
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, text string")


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([("q", [1.0, 0.0, 0.0]), ("r", [0.0, 0.0, 2.0])], "query_id string, embedding array<float>")


def hits(df, query="q"):
    return [(r.vec_id, round(r.relevance, 4)) for r in df.where(F.col("query_id") == query).orderBy("rank").collect()]


def test_dot_prefers_length_and_breaks_ties_by_id(vectors, queries):
    assert hits(topk_dot(queries, vectors, 4)) == [(2, 3.0), (0, 1.0), (5, 1.0), (1, 0.9)]


def test_l2_prefers_the_nearest(vectors, queries):
    assert hits(topk_l2(queries, vectors, 3)) == [(0, 1.0), (5, 1.0), (1, 0.98)]


def test_fewer_vectors_than_k(vectors, queries):
    assert len(hits(topk_dot(queries, vectors, 50))) == 6


def test_blocks_give_the_same_hits(spark, partitions):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[150:200] = x[:50]  # copies
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.withColumnRenamed("vec_id", "query_id")
    want = {}
    scores = np.round(x @ x.T, 12)
    for q in range(300):
        want[q] = sorted(range(300), key=lambda v: (-scores[q, v], v))[:6]
    for n, blocks in ((1, {}), (8, {}), (8, {"max_broadcast_rows": 10, "rows_per_block": 64})):
        partitions(n)
        got = topk_dot(asked, df, 6, **blocks).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("h"))
        assert {r.query_id: [h.vec_id for h in r.h] for r in got.collect()} == want


def test_no_pair_is_shuffled(vectors, queries):
    plan = topk_dot(queries, vectors)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_neighbours(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([("q", 1), ("q", 3), ("r", 0)], "query_id string, node long")
    got = sorted((r.query_id, r.node) for r in expand_neighbors(nodes, edges).collect())
    assert got == [("q", 0), ("q", 1), ("q", 2), ("q", 3), ("r", 0), ("r", 1)]


def test_graph_expansion(spark, vectors, queries):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert hits(graph_retrieve(queries, vectors, edges, 2)) == hits(topk_dot(queries, vectors, 2))
    wide = hits(graph_retrieve(queries, vectors, edges, 2, keep_expanded=True))
    assert wide == [(2, 3.0), (0, 1.0), (1, 0.9), (3, 0.0)]


def test_hybrid_drops_repeated_texts(vectors, queries):
    texts = vectors.select("vec_id", "text")
    got = hybrid_search(queries, vectors, texts, k=3).where("query_id = 'q'").orderBy("rank").collect()
    assert [(r.text, round(r.relevance, 4)) for r in got] == [("t2", 3.0), ("t0", 1.0), ("t5", 1.0)]


def test_contexts_and_fixed_messages(spark, vectors, queries):
    texts = vectors.select("vec_id", "text")
    found = build_context(queries, hybrid_search(queries, vectors, texts, k=2), vectors).collect()
    assert {r.query_id: r.context for r in found} == {"q": "t2\n\nt0", "r": "t4\n\nt0"}
    nothing = hybrid_search(queries, vectors, texts.where("false"), k=2)
    assert {r.context for r in build_context(queries, nothing, vectors).collect()} == {NO_HITS}
    assert {r.context for r in build_context(queries, nothing, vectors.where("false")).collect()} == {EMPTY_COLLECTION}


def test_embeddings_have_unit_length_and_find_their_text(spark):
    texts = ["the cat sat on the mat", "spark runs queries on clusters", "rivers flow to the sea"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "vec_id long, text string")
    model = fit_embedder(df)
    vectors = embed(df, model)
    for row in vectors.collect():
        assert abs(np.linalg.norm(row.embedding) - 1) < 1e-5
    best = topk_dot(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 1).collect()
    assert all(r.query_id == r.vec_id for r in best)


def test_answer_contexts_end_to_end(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "epsilon")], "query_id long, text string")
    assert answer_contexts(docs, asked, k=1).first().context == "delta epsilon zeta"
