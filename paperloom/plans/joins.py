"""Joining many rows to a table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
MAX_BROADCAST_BYTES = 64 << 20


def lookup_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", max_broadcast_rows: int = 200_000
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``on``; already written, so counting it is cheap).

    A table of at most ``max_broadcast_rows`` rows and ``MAX_BROADCAST_BYTES`` bytes, both
    checked, is broadcast.  A larger one is copied once per salt, so a key holding many rows spreads over that many tasks.
    """
    on = list(on)
    small = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= MAX_BROADCAST_BYTES
    if small and table.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return rows.join(F.broadcast(table), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    # Spark judges the copied table by the bytes of its files and would broadcast all copies
    return spread.join(salted.hint("merge"), [*on, "_salt"], how).drop("_salt")
