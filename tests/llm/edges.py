"""Rows that every operator must survive: NULLs, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank.\nSecond line here.\nThird line.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank.\nSecond line here.\nThird line.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank.\nSecond line here.\nThird line.", "en", "a"),
    (2, "another text under the same id", None, "b"),
    (3, None, "en", None),
    (4, "", None, "c"),
    (5, " \t\r\n ", "de", "c"),
    (6, "Über-Straße «Zürich» naïve ĲΣΑΣ İstanbul é 你好 \x1cx  y <|endoftext|> it's 12½", "de", "c"),
    (None, "no id at all", "en", "d"),
    (None, None, None, None),
    (7, LONG, "en", "e"),
    (8, "one", "en", "e"),
    (9, "!!! ... 123", "fr", "e"),
    (10, "a\n\n\nb\n\n\n", "fr", "e"),
]

#: names that operators use inside
CLASHING = "ids task before fp least_id root component_id node key free n _row _ka _kb removed marks found segment phrase doc place seed score label start length".split()


def docs(spark: SparkSession, rows=None) -> DataFrame:
    rows = ROWS if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(i, t, lang, src, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, lang, src in rows]
    return spark.createDataFrame(data, schema)


def empty(spark: SparkSession) -> DataFrame:
    return docs(spark, [])
