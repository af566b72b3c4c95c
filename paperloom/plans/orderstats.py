"""Exact order statistics and quantiles that survive hot groups.

``percentile`` and ``sort_array(collect_list(..))`` keep a whole group in one
task.  Here only groups below a size limit are treated that way.  A larger
group is cut into value buckets whose edges come from a mergeable quantile
sketch.  Counting the buckets tells which of them holds a wanted rank, and only
that bucket is shuffled and sorted.  The sketch decides how even the buckets are,
never the answer, so results are exact.  The input is read several times; an
expensive one should be written first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 20_000

Point = tuple[float, Callable[[Column], Column]]


def _cut_shares(points: Mapping[str, Point]) -> list[float]:
    slack = 4.0 / SKETCH_ACCURACY
    shares = set()
    for share, _ in points.values():
        shares.update((max(0.0, share - slack), min(1.0, share + slack)))
    return sorted(shares)


def _sketch(shares: Sequence[float]) -> Column:
    return F.percentile_approx("_v", [float(s) for s in shares], SKETCH_ACCURACY)


def _bucket(cuts: Column, n_cuts: int) -> Column:
    """Monotone in ``_v``: the number of cuts that lie strictly below it."""
    return reduce(lambda a, b: a + b, [(F.col("_v") > cuts[i]).cast("int") for i in range(n_cuts)])


def _pick_by_bucket(bucketed: DataFrame, keys: Sequence[str], points: Mapping[str, Point]) -> DataFrame:
    """``bucketed``: keys, _v, _b.  One output row per key with each wanted value.

    The buckets are counted with a map-side aggregation; only rows of the buckets that
    hold a wanted rank are shuffled, copies collapsed first.
    """
    keys = list(keys)
    counts = bucketed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    # at most 2 * len(points) + 1 rows per key reach these windows
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys,
        "_b",
        "_c",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_below"),
        F.sum("_c").over(whole).alias("n"),
    )

    def inside(rank: Callable[[Column], Column], low: Column, high: Column) -> Column:
        wanted = rank(F.col("n"))
        return (wanted >= low) & (wanted < high)

    holds = [inside(rank, F.col("_below"), F.col("_below") + F.col("_c")) for _, rank in points.values()]
    targets = counts.where(reduce(lambda a, b: a | b, holds)).select(*keys, "_b", "_below", "n")
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = (
        bucketed.join(F.broadcast(targets), [*keys, "_b"])
        .groupBy(*keys, "_b", "_v")
        .agg(F.count("*").alias("_w"), F.max("_below").alias("_below"), F.max("n").alias("n"))
        .withColumn("_high", F.col("_below") + F.sum("_w").over(in_bucket))
    )
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when(inside(rank, F.col("_high") - F.col("_w"), F.col("_high")), F.col("_v"))).alias(name)
            for name, (_, rank) in points.items()
        ],
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    points: Mapping[str, Point],
    hot_rows: int = 100_000,
    max_hot_keys: int = 100_000,
) -> DataFrame:
    """Values at given 0-based ranks of ``value`` within each key group, NULLs left out.

    ``points`` maps an output name to ``(share, rank)`` where ``rank(n)`` gives the
    exact rank from the group size and ``share`` is where it lies, roughly, in 0..1.
    A group is hot above ``max(hot_rows, rows / max_hot_keys)`` rows, so at most
    ``max_hot_keys`` keys are ever broadcast.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    shares = _cut_shares(points)
    n_cuts = len(shares)
    if not keys:
        cuts = rows.agg(_sketch(shares).alias("_cuts")).scalar()
        bucketed = rows.withColumn("_b", _bucket(cuts, n_cuts))
        return _pick_by_bucket(bucketed, [], points)

    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    share_of_all = rows.agg(F.count("*") / max_hot_keys).scalar()
    hot_keys = sizes.where(F.col("_n") > F.greatest(F.lit(float(hot_rows)), share_of_all)).select(*keys)
    # only hot keys pay for a sketch
    hot = rows.join(F.broadcast(hot_keys), keys).groupBy(*keys).agg(_sketch(shares).alias("_cuts"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = (
        marked.where(F.col("_cuts").isNull())
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        .withColumn("n", F.size("_all").cast("long"))
        .select(*keys, "n", *[F.get("_all", rank(F.col("n")).cast("int")).alias(p) for p, (_, rank) in points.items()])
    )
    bucketed = marked.where(F.col("_cuts").isNotNull()).withColumn("_b", _bucket(F.col("_cuts"), n_cuts)).drop("_cuts")
    return cold.unionByName(_pick_by_bucket(bucketed, keys, points))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    shares: Mapping[str, float],
    hot_rows: int = 100_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation per key group: keys, n, one column per name."""
    points: dict[str, Point] = {}
    for name, share in shares.items():
        position = lambda n, s=share: (n - 1) * F.lit(float(s))
        points[f"_lo_{name}"] = (share, lambda n, at=position: F.floor(at(n)))
        points[f"_hi_{name}"] = (share, lambda n, at=position: F.ceil(at(n)))
    found = order_statistics(df, keys, value, points, hot_rows=hot_rows)

    def lerp(name: str, share: float) -> Column:
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        at = (F.col("n") - 1) * F.lit(float(share))
        return low + (high - low) * (at - F.floor(at))

    return found.select(*keys, "n", *[lerp(name, share).alias(name) for name, share in shares.items()])
