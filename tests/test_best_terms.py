"""The best terms of documents, scored and chosen in batches, against scores of the JVM and words compared one by one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_similar_words import _brute
from test_terms import TEXTS

from paperloom.functions import similar as S
from paperloom.functions import terms as T
from paperloom.operators.keywords import ENGLISH_STOP_WORDS, extract_keywords, extract_keywords_by_chunk, rank_terms, score_terms, term_statistics

KIND = pa.list_(pa.struct([("sentence", pa.int32()), ("tokens", pa.list_(pa.string()))]))


def _rows():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdé", k=rnd.randint(3, 6))) for _ in range(300)]
    return TEXTS + [(f"r{i}", ". ".join(rnd.choice([str.title, str.upper, str])(w) for w in rnd.choices(words, k=90))) for i in range(12)]


@pytest.mark.parametrize("limit,top", [(0.7, 30), (0.9, 4), (1.0, 20)])
def test_best_terms_equal_scores_of_the_jvm(spark, limit, top):
    df = spark.createDataFrame(_rows(), "key string, text string")
    scored = {}
    for r in score_terms(term_statistics(df, ["key"], "text"), ["key"]).collect():
        scored.setdefault(r.key, []).append((round(r.score, 12), r.term))
    want = {}
    for key, terms in scored.items():
        terms.sort()
        places = _brute([t for _, t in terms], limit, top) if limit < 1 else range(min(top, len(terms)))
        want |= {(key, at): terms[p] for at, p in enumerate(places, 1)}
    got = {(r.key, r["rank"]): (r.score, r.keyword) for r in rank_terms(df, ["key"], "text", top, limit, ENGLISH_STOP_WORDS).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=2e-12) for k in want)


@pytest.mark.parametrize("pairs", [S.PAIRS, 40])
def test_lists_side_by_side_equal_each_alone(monkeypatch, pairs):
    monkeypatch.setattr(S, "PAIRS", pairs)
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choices("abc", k=rnd.randint(0, 9))) for _ in range(500)} | {"ab" * 40, "ab" * 41})
    lists = [rnd.sample(range(len(words)), rnd.randint(0, 80)) for _ in range(40)]
    offsets = np.cumsum([0, *map(len, lists)])
    for limit, top in [(0.7, 150), (0.6, 5), (0.9, 20), (1.0, 7)]:
        got = S.dissimilar_members(words, np.array(sum(lists, [])), offsets, limit, top)
        want = [_brute([words[w] for w in found], limit, top) if limit < 1 else list(range(min(top, len(found)))) for found in lists]
        assert got.tolist() == [int(start) + p for start, places in zip(offsets, want) for p in places]


def test_only_the_best_terms_leave_the_task(spark):
    """Features of all terms are not sent back, and no second Python worker compares them."""
    df = spark.createDataFrame(TEXTS, "key string, text string")
    for query in (extract_keywords, extract_keywords_by_chunk):
        plan = query(df, ["key"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "tf_upper" not in plan


def test_memory_of_a_batch_is_bounded():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(2000)]
    documents = pa.array([[{"sentence": 0, "tokens": rnd.choices(words, k=1000)}] for _ in range(1200)], KIND)
    tracemalloc.start()
    found = T.best_terms(documents, frozenset(), 0.9, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1200 and set(found.value_lengths().to_pylist()) == {20}
    assert peak < 100e6
