import math

import pytest

from paperloom.operators.keywords import (
    extract_keywords,
    extract_keywords_by_chunk,
    keyword_records,
    keyword_reports,
    merge_keywords,
    rank_terms,
    score_terms,
    term_statistics,
)
from paperloom.operators.label_csv import label_keywords, parse_label_csv

TEXT = "Graph stores link data. Graph queries follow links. NASA keeps data in a Graph store; data, data!"


def test_term_features(spark):
    df = spark.createDataFrame([("d", TEXT)], "source string, text string")
    rows = {r.term: r for r in term_statistics(df, ["source"], "text").collect()}
    graph, data, nasa = rows["graph"], rows["data"], rows["nasa"]
    assert (graph.tf, graph.tf_upper, graph.n_sentences, graph.median_sentence) == (3, 1, 3, 1.0)
    assert (data.tf, data.n_sentences, data.d_left, data.n_left) == (4, 2, 4, 4)
    assert (nasa.tf_acronym, nasa.tf_upper, nasa.n_left, nasa.d_right) == (1, 0, 0, 1)
    assert rows["in"].is_stop and not data.is_stop


def test_score_by_hand(spark):
    df = spark.createDataFrame([("d", "cat dog cat")], "source string, text string")
    stats = term_statistics(df, ["source"], "text")
    rows = {r.term: r.score for r in score_terms(stats, ["source"]).collect()}
    position, typical = math.log(math.log(3)), 1.5 + 0.5
    related = 1 + (1 / 1 + 1 / 1) * 2 / 2
    weight = related * position / (0 + (2 / typical) / related + 1 / related)
    assert rows["cat"] == pytest.approx(weight / ((1 + weight) * 2))
    assert rows["cat"] < rows["dog"]


def test_near_duplicates_are_skipped_greedily(spark):
    text = "analysis analysis analysis analyses analyses planet"
    df = spark.createDataFrame([("d", text)], "source string, text string")
    loose = [r.keyword for r in extract_keywords(df, dedup_limit=0.7).orderBy("rank").collect()]
    exact = [r.keyword for r in extract_keywords(df, dedup_limit=1.0).orderBy("rank").collect()]
    assert loose == ["analysis", "planet"] and sorted(exact) == ["analyses", "analysis", "planet"]


def test_dedup_threshold_matches_its_definition(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = ["abcdefghij", "abcdefgxyz", "abcdefghxy", "abcd", "abcx", "zzzz", "zzzzz", "q", "qq"]
    pairs = [(a, b) for a in words for b in words if a < b]
    for limit in (0.6, 0.7, 0.75, 0.8, 0.9):
        df = spark.createDataFrame([(f"{a}-{b}", f"{a} {a} {b}") for a, b in pairs], "source string, text string")
        got = rank_terms(df, ["source"], "text", 5, limit, ["none"])
        kept = {r["source"]: r["n"] for r in got.groupBy("source").agg({"keyword": "count"}).withColumnRenamed("count(keyword)", "n").collect()}
        for a, b in pairs:
            if min(len(a), len(b)) < 3:
                continue  # short words count as stop words
            similar = 1 - distance(a, b) / max(len(a), len(b)) > limit + 1e-12
            assert kept[f"{a}-{b}"] == (1 if similar else 2), (a, b, limit)


def test_filter_comes_after_the_cut(spark):
    df = spark.createDataFrame([("d", "image image image image word word term")], "source string, text string")
    assert [r.keyword for r in extract_keywords(df, top_n=2).collect()] == ["word"]


def test_one_exchange_serves_all_features(spark):
    df = spark.createDataFrame([("d", TEXT)], "source string, text string")
    plan = extract_keywords(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_chunked_extraction_and_merge(spark):
    text = " ".join(["zebra apple"] * 200 + ["mango"])
    df = spark.createDataFrame([("d", text)], "source string, text string")
    chunks = extract_keywords_by_chunk(df)
    assert {r.chunk_id for r in chunks.collect()} == {0, 1}
    merged = merge_keywords(chunks, max_keywords=2).orderBy("rank").collect()
    assert [(r.rank, r.keyword) for r in merged] == [(1, "apple"), (2, "mango")]


def test_records_and_reports(spark):
    df = spark.createDataFrame([("d", 2, "b"), ("d", 1, "z")], "source string, rank int, keyword string")
    records = keyword_records(df)
    assert tuple(records.first()) == ("d", ["z", "b"], 2)
    assert keyword_reports(records).first().report == "Keywords extracted from: d\n" + "=" * 50 + "\n 1. z\n 2. b\n"


RESPONSES = [
    (1, "Sure, here it is\nKeyword,Category\n Foo , tech\n\n``````\nbar,Medicines,extra\nfoo,Art\nnan,City\nquux\n\"a, b\",Law\nbaz,\nqux,zzz"),
    (2, "no table at all"),
    (3, "keyword,category\nwrong,Art"),
]


def test_label_csv(spark):
    responses = spark.createDataFrame(RESPONSES, "response_id int, csv_text string")
    asked = spark.createDataFrame(
        [(1, "FOO"), (1, "bar"), (1, "a, b"), (1, "qux"), (1, "baz"), (2, "scar"), (3, "London")], "response_id int, keyword string"
    )
    got = sorted(tuple(r) for r in parse_label_csv(responses, asked).collect())
    assert got == [(1, "a, b", "Law"), (1, "bar", "Medicine"), (1, "foo", "Technology"), (1, "qux", "Other")]
    full = sorted(tuple(r) for r in label_keywords(responses, asked).collect())
    assert full == sorted([*got, (2, "scar", "Transportation"), (3, "london", "City")])
