"""Term statistics counted in batches against a count in plain Python, and the plan behind them."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from paperloom.functions import terms as T
from paperloom.operators.keywords import ENGLISH_STOP_WORDS, TOTALS, extract_keywords, score_terms, term_statistics

TEXTS = [
    ("a", "Red FOX. red hen, RED-hot Fox 12 Ⅷ fox!\n\nNASA and NASA's Été été É"),
    ("a", "Fox hen. Hen"),
    ("b", "..."),
    ("c", None),
    (None, "the the Straße STRASSE 3.5 x2 ÄÖ Äö"),
    (None, "Red"),
    ("d", " ".join(f"Word{i % 7} w{i % 11}. Cut{i % 3}" for i in range(60))),
]


def counted(rows):
    out = collections.defaultdict(lambda: {"tf": 0, "up": 0, "acro": 0, "s": set(), "l": [], "r": []})
    for key, text in rows:
        for n, sentence in enumerate(re.split(r"(?<=[.!?])\s+|\n+", text or "")):
            tokens = re.findall(r"[^\W_]+(?:[-'’][^\W_]+)*", sentence)
            for i, token in enumerate(tokens):
                if all(c.isnumeric() for c in token):
                    continue
                o = out[key, token.lower()]
                acronym = len(token) > 1 and token.isalpha() and all(c.isupper() for c in token)
                o["tf"] += 1
                o["acro"] += acronym
                o["up"] += token[0].isupper() and not acronym and i > 0
                o["s"].add(n)
                o["l"] += [tokens[i - 1].lower()] if i else []
                o["r"] += [tokens[i + 1].lower()] if i + 1 < len(tokens) else []
    return {
        k: (o["tf"], o["up"], o["acro"], len(o["s"]), float(np.median(list(o["s"]))), max(o["s"]), len(o["l"]), len(o["r"]), len(set(o["l"])), len(set(o["r"])),
            k[1] in ENGLISH_STOP_WORDS or len(k[1]) < 3)
        for k, o in out.items()
    }


@pytest.mark.parametrize("tokens", [1 << 20, 8])
def test_statistics_equal_a_plain_count(spark, monkeypatch, tokens):
    monkeypatch.setattr(T, "TOKENS", tokens)
    df = spark.createDataFrame(TEXTS, "key string, text string")
    rows = term_statistics(df, ["key"], "text").collect()
    assert len(rows) == len({(r.key, r.term) for r in rows})
    assert {(r.key, r.term): tuple(r)[2:-3] for r in rows} == counted(TEXTS)


def test_batches_are_cut_by_documents(monkeypatch):
    kind = pa.list_(pa.struct([("sentence", pa.int32()), ("tokens", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))]))
    words = [[], ["b"], ["a", "b", "a"], [], ["c"] * 5]
    documents = pa.array([[{"sentence": 0, "tokens": w, "terms": w}] if w else [] for w in words], kind)

    def found():
        return [sorted(d, key=lambda t: t["term"]) for d in T.term_features(documents, frozenset()).to_pylist()]

    whole = found()
    monkeypatch.setattr(T, "TOKENS", 2)
    assert found() == whole and [[t["term"] for t in d] for d in whole] == [[], ["b"], ["a", "b"], [], ["c"]]
    assert T.term_features(documents.slice(0, 0), frozenset()).to_pylist() == []


def test_totals_equal_windows(spark):
    df = spark.createDataFrame(TEXTS, "key string, text string")
    with_totals = term_statistics(df, ["key"], "text")
    want = {(r.key, r.term): r.score for r in score_terms(with_totals.drop(*TOTALS), ["key"]).collect()}
    got = {(r.key, r.term): r.score for r in score_terms(with_totals, ["key"]).collect()}
    assert want.keys() == got.keys() and len(got) > 10
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_tokens_are_no_rows(spark):
    """Documents grow to rows of terms only, and no window sorts them."""
    df = spark.createDataFrame(TEXTS, "key string, text string")
    plan = extract_keywords(df, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Window" not in plan and plan.count("Exchange ") == 1
