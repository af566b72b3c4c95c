"""Run registered queries against DuckDB on the same tables: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def differences(spark_df, con, sql: str) -> str | None:
    """None when names, row counts, types (roughly) and values agree."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in order) for r in spark_df.collect()]
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want, got = sorted(want, key=key), sorted(got, key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w or any(type(a) is not type(b) for a, b in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ ({order}): {str(bad[0][0])[:700]} != {str(bad[0][1])[:700]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = contract.oracle_sql()
    for name, run in contract.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                verdict = differences(df, con, oracles[name]) or "ok"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:900]}"
        print(f"{name:32s} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
