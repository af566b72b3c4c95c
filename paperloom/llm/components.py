"""Connected components by alternating stars, each round written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (a, b) with a > b.  Large: neighbours above a node move to its least neighbour; small: those below."""
    sides = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        sides = sides.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = sides.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    # written, so that the join below meets two plain exchanges and a hub's rows can be split
    least = stage(least, "star-least")
    near = sides.join(least, "node")
    if large:
        moved = near.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        moved = near.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over ``links`` (a, b), for every node of a link.

    Each round of one large and one small star at least halves the height of what is left, so
    chains of n nodes end after about log n rounds.  A round that changes nothing ends it.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stage(pairs, "links")
    mark = None
    while True:
        new_mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new_mark == mark or not new_mark[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = new_mark
        current = stage(_stars(stage(_stars(current, True), "large-star"), False), "small-star")
