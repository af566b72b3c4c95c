from pyspark.sql import functions as F

from paperloom.llm import toxicity


def test_few_rows_are_ranked_and_the_sample_is_the_same(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    ranked = labels.select("doc_id", "label", F.xxhash64("doc_id").alias("hash")).collect()
    want = {r.doc_id for k in (0, 1) for r in sorted((r for r in ranked if r.label == k), key=lambda r: (r.hash, r.doc_id))[:300]}
    found = toxicity._sample(labels, 300)
    assert sorted(r.doc_id for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "hash" in plan.split("Window", 1)[1] and " <= " in plan.split("Window", 1)[1]  # cut before the ranking
    assert toxicity._sample(labels.where("doc_id < 0"), 300).count() == 0
