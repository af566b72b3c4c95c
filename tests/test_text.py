"""Text functions against plain Python on awkward characters."""

import re

from pyspark.sql import functions as F

from paperloom.functions.labels import categorize_by_rules, validate_category
from paperloom.functions.text import (
    clean_for_keywords,
    clean_lines,
    collapse_whitespace,
    fixed_slices,
    keyword_ok,
    row_line,
    sanitize_filename,
)

TEXTS = [
    "",
    "   ",
    "a\tb  c\r\n\r\n  d  e \n",
    "one two three\x0bfour\x0cfive",
    "x\x1cy\x1dz\x1ew\x1fv",
    "tail　space \n\n\nend",
    "\u0085next line",
    "plain",
]


def apply(spark, texts, column):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_clean_lines_follows_unicode_rules(spark):
    def plain(text):
        lines = (re.sub(r"\s+", " ", line.strip()) for line in text.splitlines())
        return "\n".join(line for line in lines if line)

    assert apply(spark, TEXTS, clean_lines) == [plain(t) for t in TEXTS]


def test_collapse_whitespace(spark):
    want = [re.sub(r"\s+", " ", t).strip() for t in TEXTS]
    assert apply(spark, [*TEXTS, None], collapse_whitespace) == [*want, ""]


def test_clean_for_keywords_joins_neighbours(spark):
    texts = ["e-mail • “x” it's", "a 12 b12 3c 4\n5 d", "café 9é 9", "  lead  two "]
    assert apply(spark, texts, clean_for_keywords) == ["email x its", "a  b12 3c   d", "caf 9", "lead two"]


def test_keyword_ok(spark):
    words = ["cat", "ca", "Image", "x9y", "the", "été", "", "well known"]
    assert apply(spark, words, keyword_ok) == [True, False, False, False, False, True, False, False]


def test_sanitize_filename(spark):
    assert apply(spark, ['a<b>:"c/\\d|e?f*', "r→sé"], sanitize_filename) == ["a_b___c__d_e_f_", "rs"]


def test_fixed_slices_count_code_points(spark):
    text = "\U0001f600" * 5 + " ab"
    (slices,) = apply(spark, [text], lambda t: fixed_slices(t, 4))
    assert slices == ["\U0001f600" * 4, "\U0001f600 ab"]
    assert apply(spark, ["", " \n "], lambda t: fixed_slices(t, 4)) == [[], []]


def test_row_line_marks_missing_cells(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, 2.5, None)], "a int, b double, c string")
    assert [r[0] for r in df.select(row_line(["a", "b", "c"])).collect()] == ["1 NaN x", "NaN 2.5 NaN"]


def test_validate_category(spark):
    names = [" technology ", "tech", "Medicines", "ART", "Partners", "???", ""]
    # the empty string is part of every name, so the first one wins
    assert apply(spark, names, validate_category) == [
        "Technology", "Technology", "Medicine", "Art", "Art", "Other", "Country",
    ]


def test_categorize_by_rules_takes_the_first_category(spark):
    words = ["scar", "database", "climate", "usable", "Rainforest", "zzz"]
    assert apply(spark, words, categorize_by_rules) == [
        "Transportation", "Technology", "Weather", "Country", "Transportation" if "train" in "rainforest" else "Weather", "Other",
    ]
