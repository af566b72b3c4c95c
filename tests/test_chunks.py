from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators.chunks import chunk_fixed, chunk_recursive, next_chunk_edges, split_recursive
from paperloom.operators.dedupe import dedupe_keep_first


def test_split_prefers_blank_lines():
    text = "a" * 300 + "\n\n" + "b" * 300 + "\n\n" + "c" * 100
    assert split_recursive(text) == ["a" * 300, "b" * 300 + "\n\n" + "c" * 100]


def test_split_long_word():
    chunks = split_recursive("x" * 1200)
    assert [len(c) for c in chunks] == [500, 500, 300]


def test_split_overlap_repeats_whole_pieces():
    text = " ".join(f"w{i:03d}" for i in range(300))
    chunks = split_recursive(text)
    assert all(len(c) <= 500 for c in chunks)
    for before, after in zip(chunks, chunks[1:]):
        shared = after.split(" ")[0]
        assert shared in before.split(" ")  # a tail of at most 50 characters is repeated
        assert 0 < len(before) - before.index(shared) <= 50


def test_split_short_and_empty():
    assert split_recursive("") == [] and split_recursive("  \n ") == [] and split_recursive(" ab ") == ["ab"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_split_invariants(text):
    chunks = split_recursive(text, size=20, overlap=5)
    assert all(chunk and len(chunk) <= 20 and chunk == chunk.strip() for chunk in chunks)
    assert set("".join(chunks)) >= set(text) - {" ", "\n"}
    at = 0  # chunks appear in order in the text
    for chunk in chunks:
        found = text.find(chunk, max(0, at - 20))
        assert found >= 0
        at = found + len(chunk)


def test_chunk_ids_restart_per_document(spark):
    df = spark.createDataFrame([("d", "x" * 1200), ("e", "y" * 700), ("f", ""), ("g", None)], "source string, text string")
    got = sorted((r.source, r.chunk_id, len(r.text)) for r in chunk_recursive(df).collect())
    assert got == [("d", 0, 500), ("d", 1, 500), ("d", 2, 300), ("e", 0, 500), ("e", 1, 250)]


def test_fixed_chunks(spark):
    df = spark.createDataFrame([("d", " ab\n\ncd ef ")], "source string, text string")
    assert [(r.chunk_id, r.text) for r in chunk_fixed(df, size=3).collect()] == [(0, "ab "), (1, "cd "), (2, "ef")]


def test_contiguous_edges_need_no_shuffle(spark):
    df = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2), ("e", 0)], "source string, chunk_id int")
    edges = next_chunk_edges(df, contiguous=True)
    assert sorted((r.source, r.src, r.dst) for r in edges.collect()) == [("d", 0, 1), ("d", 1, 2)]
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()


def test_edges_with_gaps_across_buckets(spark):
    ids = [0, 1, 9, 10, 35, 36, 99]
    df = spark.createDataFrame([("d", i) for i in ids] + [("e", 50)], "source string, chunk_id int")
    edges = next_chunk_edges(df, bucket_rows=10)
    assert sorted((r.src, r.dst) for r in edges.collect()) == list(zip(ids, ids[1:]))


def test_dedupe_keeps_the_first_row_whole(spark):
    df = spark.createDataFrame([("t", 3, "c"), ("t", 1, None), ("u", 2, "b"), ("t", 2, "x")], "k string, o int, v string")
    assert sorted(tuple(r) for r in dedupe_keep_first(df, ["k"], ["o"]).collect()) == [("t", 1, None), ("u", 2, "b")]


def test_dedupe_is_reduced_before_the_shuffle(spark):
    df = spark.range(100).select(F.lit("same").alias("k"), F.col("id").alias("o"))
    plan = dedupe_keep_first(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
