import json

from pyspark.sql import functions as F

from paperloom.operators.assemble import (
    assemble_pages,
    assemble_paragraphs,
    flag_short_pages,
    flat_text,
    flatten_json,
    rows_to_text,
)


def test_pages_in_order(spark):
    df = spark.createDataFrame([("d", 2, " b  b \n\n"), ("d", 1, "a"), ("e", 1, None)], "k string, p int, t string")
    got = {r.k: r.text for r in assemble_pages(df, ["k"], "p", "t").collect()}
    assert got == {"d": "\n--- Page 1 ---\na\n\n--- Page 2 ---\nb b\n", "e": "\n--- Page 1 ---\n\n"}


def test_one_row_per_document_from_any_order_value(spark):
    df = spark.range(9_990, 30_010, 1).select(F.lit("d").alias("k"), F.col("id").alias("n"), F.col("id").cast("string").alias("t"))
    rows = assemble_paragraphs(df, ["k"], "n", "t").collect()
    assert [(r.k, r.text) for r in rows] == [("d", "\n".join(str(i) for i in range(9_990, 30_010)))]
    late = spark.createDataFrame([("s", 20_001, "b"), ("s", 20_000, "a")], "sheet string, n int, c string")
    assert [r.text for r in rows_to_text(late, ["c"], "n", ["sheet"], header=True).collect()] == ["c\na\nb"]
    by_name = spark.createDataFrame([("k", "b", "2"), ("k", "a", "1")], "k string, n string, t string")
    assert assemble_paragraphs(by_name, ["k"], "n", "t").first().text == "1\n2"


def test_short_pages(spark):
    df = spark.createDataFrame([("  123456789 ",), ("1234567890",), (None,)], "t string")
    assert [r.needs_ocr for r in flag_short_pages(df, "t").collect()] == [True, False, True]


def test_rows_to_text_with_header(spark):
    df = spark.createDataFrame([("s", 1, "b", None), ("s", 0, "a  x", 1.5)], "sheet string, n int, c string, v double")
    assert rows_to_text(df, ["c", "v"], "n", ["sheet"], header=True).first().text == "c v\na x 1.5\nb NaN"
    assert rows_to_text(df, ["c", "v"], "n").first().text == "a  x 1.5\nb NaN"


DOCS = ['{"a": 1}', '{"a": {"b": 1}}', '{"z": [5, {"c": null}], "b": {}}', "true", "[1.0, \"x\"]", "{broken", None]


def test_flatten_json_paths(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i int, j string")
    rows = flatten_json(df, "j", ["i"]).orderBy("i", "ord").collect()
    assert [(r.i, r.path, r.value) for r in rows] == [
        (0, "a", "1"), (1, "a.b", "1"), (2, "z.0", "5"), (2, "z.1.c", "None"), (3, "", "True"), (4, "0", "1.0"), (4, "1", "x"),
    ]


def test_flatten_json_compatible_text(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i int, j string")
    text = {r.i: r.text for r in flat_text(flatten_json(df, "j", ["i"], compat=True), ["i"]).collect()}
    assert text == {0: "a: 1", 1: "ab.: 1", 2: "z0.: 5\nz1.c.: None", 3: ": True", 4: "0.: 1.0\n1.: x"}


def test_flatten_json_depth_is_not_bounded(spark):
    deep = "[" * 400 + "7" + "]" * 400
    df = spark.createDataFrame([(1, deep)], "i int, j string")
    row = flatten_json(df, "j", ["i"]).first()
    assert row.path == ".".join("0" * 400) and row.value == "7"
    assert json.loads(deep)


def test_json_deeper_than_the_parser_has_no_leaves(spark):
    df = spark.createDataFrame([(1, "[" * 200_000 + "]" * 200_000), (2, "[3]")], "i int, j string")
    assert [(r.i, r.value) for r in flatten_json(df, "j", ["i"]).collect()] == [(2, "3")]
