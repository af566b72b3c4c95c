"""All-against-all work without a cross join and without emitting pairs.

One side is met by the other in bounded blocks of vectors; each block meeting
returns only its partial result (a local top-k, a sum, a maximum), which the
caller merges with an ordinary aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BlockFn = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]

LEAST_BLOCK_ROWS = 256  # a table is not cut finer than this to occupy all cores
MAX_PARTITIONS = 4_096


def meet_in_blocks(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    fn: BlockFn,
    schema: str,
    max_broadcast_rows: int = 4_096,
    rows_per_block: int = 16_384,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    merge_rows: int = 200_000,
    exchange_rows: int = 16_384,
) -> DataFrame:
    """Run ``fn(left_block, right_block)`` so that every left row meets every right row once.

    A right side of at most ``max_broadcast_rows`` rows (checked) is shipped to the
    tasks that scan the left side.  Beyond that both sides are hashed into blocks of
    about ``exchange_rows`` rows and each pair of blocks becomes one group, so each
    side is copied once per block of the other; ``fn`` then gets the right rows of a
    group ``rows_per_block`` at a time.  ``merge`` shrinks stacked
    partial results (a top list); a scanning task then emits one merged result
    instead of one per batch.
    """
    small = right.limit(max_broadcast_rows + 1).toPandas()
    if len(small) <= max_broadcast_rows:

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                if not len(batch) or not len(small):
                    continue
                part = fn(batch, small)
                if merge is None:
                    yield part
                    continue
                held.append(part)
                if sum(map(len, held)) > merge_rows:
                    held = [merge(pd.concat(held))]
            if held:
                yield merge(pd.concat(held))

        return left.mapInPandas(scan, schema)

    # blocks are as large as a task may hold, and smaller where that would leave cores idle
    spread = math.ceil(math.sqrt(2 * left.sparkSession.sparkContext.defaultParallelism))

    def block_count(rows: int) -> int:
        return max(1, math.ceil(rows / exchange_rows), min(spread, rows // LEAST_BLOCK_ROWS))

    left_blocks, right_blocks = block_count(left.count()), block_count(right.count())
    lhs = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.lit(left_blocks)).cast("int")).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1)))
    )
    rhs = right.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.lit(right_blocks)).cast("int")).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1)))
    )
    columns = [field.strip().split(" ")[0] for field in schema.split(",")]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=columns)
        a, b = a.drop(columns=["_lb", "_rb"]), b.drop(columns=["_lb", "_rb"])
        return pd.concat([fn(a, b.iloc[at : at + rows_per_block]) for at in range(0, len(b), rows_per_block)])

    # the number of partitions is stated, as adaptive coalescing judges by the bytes of a group and not by its products
    partitions = min(2 * left_blocks * right_blocks, MAX_PARTITIONS)
    groups = [side.repartition(partitions, "_lb", "_rb").groupBy("_lb", "_rb") for side in (lhs, rhs)]
    return groups[0].cogroup(groups[1]).applyInPandas(meet, schema)
