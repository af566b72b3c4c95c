"""All-against-all meetings: bounded slices, several blocks, copies, null and non-finite components."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators.ml.metrics import _distances
from paperloom.operators.retrieve import _BY_DOT, _BY_L2, _one_minus_l2, best_pairs, topk_l2
from paperloom.plans.blocks import meet_in_blocks

RNG = np.random.default_rng(3)
EXACT = {"dot": lambda q, x: x @ q, "l2": lambda q, x: _one_minus_l2(q, x)}


def best_of(queries, vectors, scorer, k):
    q, v, score = best_pairs(queries, vectors, scorer, k)
    return [sorted(zip(-score[q == i], v[q == i]))[:k] for i in range(len(queries))]


@pytest.mark.parametrize("name,scorer", [("dot", _BY_DOT), ("l2", _BY_L2)])
@pytest.mark.parametrize("offset", [0.0, 1e4])
def test_slices_equal_brute_force(name, scorer, offset):
    x = RNG.normal(size=(2_000, 6)).round(2) + offset
    x[500:900] = x[3]  # a large group of copies
    x[1_000:1_200] = x[:200]
    got = best_of(x[:600], x, scorer, 5)
    for i, hits in enumerate(got):
        want = np.round(EXACT[name](x[i], x), 12)
        order = np.lexsort((np.arange(len(x)), -want))[:5]
        assert [v for _, v in hits] == order.tolist() or np.allclose([-s for s, _ in hits], want[order], rtol=1e-12)


def test_non_finite_components_do_not_hide_hits():
    x = RNG.normal(size=(300, 4))
    x[7] = np.inf
    x[9, 1] = np.nan
    for i, hits in enumerate(best_of(x[:3], x, _BY_L2, 4)):
        want = np.round(_one_minus_l2(x[i], x), 12)
        assert [v for _, v in hits] == np.lexsort((np.arange(300), -np.nan_to_num(want, nan=-np.inf)))[:4].tolist()


def test_a_meeting_of_many_rows_holds_little_memory():
    x = RNG.normal(size=(6_000, 4))
    tracemalloc.start()
    best_pairs(x, x, _BY_DOT, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # the scores of all pairs are 288 MB


def test_distances_of_near_and_equal_places_are_exact():
    x = RNG.normal(size=(50, 3)) + 1e6
    x[10] = x[3]
    x[11] = x[3] + 1e-7
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(_distances(x, x), want, rtol=1e-8, atol=0)


def test_every_pair_meets_once_in_several_groups(spark):
    df = spark.range(700).withColumn("x", F.col("id").cast("double"))
    calls = lambda a, b: a[["id"]].assign(n=len(b), most=len(b))
    met = meet_in_blocks(df, df, "id", "id", calls, "id long, n long, most long", 10, 40, exchange_rows=100)
    rows = met.groupBy("id").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()
    assert len(rows) == 700 and {r.n for r in rows} == {700} and max(r.most for r in rows) <= 40


def test_blocks_of_copies_give_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "vec_id long, embedding array<float>")
    got = topk_l2(df.withColumnRenamed("vec_id", "query_id"), df, 3, max_broadcast_rows=10, rows_per_block=50)
    assert got.groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("v")).select("v").distinct().collect() == [([0, 1, 2],)]
