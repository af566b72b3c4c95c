from edges import docs, empty

import corpus_pipeline as P
from paperloom.llm import decontaminate, packing, simhash, toxicity
from paperloom.llm.common import stage
from test_simhash import groups_of

SF = "/root/testdata/sf0.001"


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_stages_on_the_documents(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    made = {}
    for name, apply in P.STAGES:
        made[name] = (given, stage(apply(spark, given, SF), name))
        given = made[name][1]
        assert name == "packing" or given.columns == columns
    before, after = made["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = toxicity.score(before, toxicity.learn(before, labels)).where("predicted = 0")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in after.collect())
    before, after = made["line_dedup"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").count() == 0
    before, after = made["near_dedup"]
    # one document of each group that pairs of fingerprints of at most 3 differing bits connect, by brute force
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode(), 3) for r in before.collect()}
    group = groups_of(set(prints.values()), 3)
    least = {}
    for i in sorted(prints):
        least.setdefault(group[prints[i]], i)
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())
    before, after = made["decontamination"]
    clean = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in after.collect())
    before, after = made["packing"]
    assert after.agg({"length": "sum"}).first()[0] == packing.tokenize(before).agg({"n": "sum"}).first()[0]


def test_edge_rows(spark):
    source = docs(spark)
    rows = source.collect()
    quiet = [P.drop_toxic(spark, source, SF), P.drop_leaks(spark, source, SF)]
    for kept in quiet:
        assert sorted(kept.collect(), key=key) == sorted(rows, key=key)
    cleaned = P.drop_repeated_lines(spark, source, SF)
    assert cleaned.columns == source.columns and cleaned.count() == len(rows)
    single = P.drop_near_duplicates(spark, source, SF)
    assert single.columns == source.columns
    found = single.collect()
    wordless = [r for r in found if not (r.text or "").split()]
    assert len(wordless) == 1 and len([r for r in found if r.doc_id in (1, 2) and "quick" in r.text]) == 1
    assert P.pack(spark, source, SF).where("start = 0").count() == len(rows)


def test_equal_rows_leave_the_least_of_their_other_columns(spark):
    rows = [(5, "same text here", "fr", "b"), (5, "same text here", "en", "c"), (5, "same text here", "en", "a"), (None, "same text here", "aa", "a")]
    for given in (rows, rows[::-1]):
        kept = P.drop_near_duplicates(spark, docs(spark, given), SF).collect()
        assert [(r.doc_id, r.lang, r.source) for r in kept] == [(5, "en", "a")]


def test_empty_table(spark):
    for _, apply in P.STAGES:
        assert apply(spark, empty(spark), SF).count() == 0
