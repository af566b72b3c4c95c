from edges import ROWS, docs, empty

from paperloom.llm import langid
from paperloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_langid"](spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    source = docs(spark)
    learned = langid.learn(source)
    assert set(learned) == {"en", "de", "fr"} and max(map(len, learned.values())) <= 64 << 10
    rows = langid.identify(source, learned).collect()
    assert len(rows) == len(ROWS)
    unknown = sum(1 for _, t, *_ in ROWS if not any(c.isalpha() for c in t or ""))
    assert sum(r.lang_pred == "und" and r.rejected and r.score == 0 for r in rows) == unknown
    assert langid.learn(empty(spark)) == {}
    assert langid.identify(empty(spark), learned).count() == 0
    assert {r.lang_pred for r in langid.identify(source, {}).collect()} == {"und"}


def test_sample_is_bounded(spark):
    rows = [(i, f"zeile {i} {'wort ' * 50}{i}", "de", "") for i in range(300)] + [(1000 + i, "same text", "en", "") for i in range(300)]
    learned = langid.learn(docs(spark, rows), rows=5, dictionary_bytes=1 << 20)
    assert learned["de"].count(b"zeile") <= 5 and learned["en"] == b"same text"


def test_narrow_margins_are_rejected(spark):
    learned = {"aa": b"alpha beta gamma delta", "bb": b"omega psi chi phi"}
    rows = {r.doc_id: r for r in langid.identify(docs(spark, [(1, "alpha beta gamma", "", ""), (2, "zzz", "", "")]), learned).collect()}
    assert rows[1].lang_pred == "aa" and not rows[1].rejected
    assert rows[2].rejected and rows[2].lang_pred == "aa"
