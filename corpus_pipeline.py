"""A corpus from raw documents: toxicity, line dedup, near-duplicates, benchmark leaks, packing.

Every stage is written as Parquet under the shared checkpoint folder and read again, so a lost
executor costs one stage.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, line_chunks, packing, simhash, toxicity
from paperloom.llm.common import boxed, row_key, stage, table, unboxed

KEY = ["_ka", "_kb"]
LEAST_ITEM_WORDS = 5


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (_row, _ka, _kb) without those whose key is in ``gone``; merged, so that one key's rows can be split."""
    return unboxed(rows.join(stage(gone.select(*KEY).distinct(), "gone").hint("merge"), KEY, "left_anti"))


def _keyed(docs: DataFrame) -> DataFrame:
    ka, kb = row_key()
    return boxed(docs, _ka=ka, _kb=kb)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from ``labels``, does not call toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    scored = toxicity.score(rows, model, keep={"_row": F.col("_row")})
    return unboxed(scored.where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two lines or more that stand earlier; ``n_chars`` follows the text."""
    cleaned = line_chunks.drop_repeated_runs(docs)
    counted = F.when(F.col("removed").isNull(), F.col("_row.n_chars")).otherwise(F.length("_row.text").cast("long"))
    return unboxed(cleaned.select(F.col("_row").withField("n_chars", counted).alias("_row")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of ``simhash.near_duplicates`` (3-word shingles, at most 3 differing bits): the one with the least id, once.

    Of rows that agree in id and text the least by lang, source and further columns stays.
    """
    ka, kb = row_key()
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ka, kb).alias("doc_id"), "text")
    found = simhash.near_duplicates(keyed, shingle=3, radius=3)
    others = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.*")
    # copies of a row meet in their task first, then in one exchange that the join below goes on with
    once = _keyed(docs).groupBy(*KEY).agg(F.min("_row").alias("_row"))
    return _without(once, others)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item, nor a whole item of 5 to 9 words.

    Items of fewer words are too common to be evidence of a leak and remove nothing.
    """
    ka, kb = row_key()
    keyed = docs.select(F.struct(ka, kb).alias("doc_id"), "text")
    items = decontaminate.longer_items(table(spark, sf_dir, "benchmark"), LEAST_ITEM_WORDS)
    found = decontaminate.contamination(keyed, items, size=10)
    return _without(_keyed(docs), found.where("n_hit > 0").select("doc_id.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, length=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# fingerprints, learned weights and token ids have no SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
