"""Joins to tables beyond the broadcast limit."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from paperloom.plans.joins import lookup_join
from paperloom.plans.materialize import materialize


def test_copies_of_a_table_beyond_the_limit_are_not_broadcast(spark):
    rows = spark.range(300).select((F.col("id") % 60).alias("k"), "id")
    table = materialize(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "small-files")
    joined = lookup_join(rows, table, ["k"], "left", max_broadcast_rows=10)
    plan = io.StringIO()
    with redirect_stdout(plan):
        joined.explain()
    assert "Broadcast" not in plan.getvalue()
    got = {(r["k"], r["id"], r["v"]) for r in joined.collect()}
    assert got == {(i % 60, i, 2 * (i % 60) if i % 60 < 50 else None) for i in range(300)}
