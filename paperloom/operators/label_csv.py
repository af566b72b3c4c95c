"""Model-written CSV answers to checked (keyword, category) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.labels import CATEGORIES, categorize_by_rules, validate_category
from paperloom.functions.text import trim_space
from paperloom.operators.dedupe import dedupe_keep_first
from paperloom.sources.tables import MISSING

HEADER = "keyword,category"  # fixed value, compared in lower case
FENCE = "``````"  # fixed value


def parse_label_csv(
    responses: DataFrame,
    requested: DataFrame,
    response_id: str = "response_id",
    text: str = "csv_text",
    valid: tuple[str, ...] = CATEGORIES,
) -> DataFrame:
    """Rows ``(response_id, keyword, category)`` of the answers that were asked for.

    Lines without a comma, code fences and header lines are dropped; the first two
    fields count; a repeated keyword keeps its first category.  ``requested``:
    response_id, keyword.
    """
    lines = responses.select(response_id, F.posexplode(F.split(text, "\n")).alias("line_no", "_raw"))
    lines = lines.withColumn("_line", trim_space("_raw"))
    lines = lines.where(
        F.col("_line").contains(",")
        & ~F.col("_line").startswith(FENCE)
        & ~F.lower("_line").startswith(HEADER)
    )
    fields = F.from_csv("_line", "keyword string, category string, rest string")
    rows = lines.select(response_id, "line_no", fields.alias("_f"))
    rows = rows.select(response_id, "line_no", "_f.keyword", "_f.category")
    for name in ("keyword", "category"):
        rows = rows.where(F.col(name).isNotNull() & ~F.col(name).isin(*MISSING))
    rows = rows.select(
        response_id,
        "line_no",
        F.lower(trim_space("keyword")).alias("keyword"),
        validate_category(trim_space("category"), valid).alias("category"),
    )
    first = dedupe_keep_first(rows, [response_id, "keyword"], ["line_no"])
    asked = requested.select(response_id, F.lower("keyword").alias("keyword"))
    return first.join(asked, [response_id, "keyword"], "left_semi").select(response_id, "keyword", "category")


def fallback_labels(keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """Rule-based categories for keywords no answer covers: all columns, keyword in lower case, category."""
    return keywords.withColumn("category", categorize_by_rules(keyword)).withColumn(keyword, F.lower(keyword))


def label_keywords(responses: DataFrame, requested: DataFrame, response_id: str = "response_id") -> DataFrame:
    """Answered labels where a request got any, rule-based labels for requests left without one."""
    answered = parse_label_csv(responses, requested, response_id)
    left = requested.join(answered.select(response_id).distinct(), response_id, "left_anti")
    return answered.unionByName(fallback_labels(left.select(response_id, "keyword")))
