"""Chunks and vectors of a collection are made once."""

from paperloom.plans import answers


def test_chunks_are_made_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(answers, "materialize", lambda df, name: written.append(name) or df.persist())
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue sky")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "red fox")], "query_id string, text string")
    found = answers.answer_contexts(docs, asked).collect()
    assert written == ["chunks", "vectors"] and found[0].context.startswith("red fox runs")
