from edges import docs

import corpus_pipeline as P


def test_short_items_remove_nothing(spark, tmp_path):
    item = "nine words or fewer stand in this"
    items = [("a", "the old"), ("b", "one"), ("c", item), ("d", " ".join(f"w{i}" for i in range(12)))]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "the old one is clean"), (2, f"here {item} item"), (3, " ".join(f"W{i}" for i in range(10))), (4, "w1 w2 w3 w4 w5 w6")]
    kept = P.drop_leaks(spark, docs(spark, [(i, t, "en", "s") for i, t in rows]), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
