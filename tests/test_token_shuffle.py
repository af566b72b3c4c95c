"""Texts are dealt by document once; neither tokens nor statistics are shuffled."""

from paperloom.operators.keywords import score_terms, term_statistics


def test_no_token_is_shuffled(spark):
    df = spark.createDataFrame([(1, "Red fox. Red hen runs."), (2, "Blue sky."), (2, "Blue sea."), (None, "Red fox.")], "doc_id long, text string")
    stats = term_statistics(df, ["doc_id"], "text")
    plan = score_terms(stats, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    tf = {(r.doc_id, r.term): (r.tf, r.n_sentences) for r in stats.collect()}
    assert tf[1, "red"] == (2, 2) and tf[2, "blue"] == (2, 1) and tf[None, "fox"] == (1, 1)
