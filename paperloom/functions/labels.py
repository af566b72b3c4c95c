"""Keyword categories: matching a free category name and rule-based assignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the expected output ---------------------------------
CATEGORIES = (
    "Country", "City", "Technology", "Health", "Transportation",
    "Weather", "Environment", "Education", "Business", "Science",
    "Politics", "Sports", "Entertainment", "Food", "Religion",
    "Military", "Economics", "Geography", "History", "Culture",
    "Medicine", "Engineering", "Agriculture", "Energy", "Communication",
    "Finance", "Law", "Art", "Literature", "Music", "Other",
)
CATEGORY_SEED_WORDS = {
    "Country": ("usa", "india", "china", "japan", "germany", "france", "britain", "russia"),
    "City": ("london", "paris", "tokyo", "newyork", "delhi", "mumbai", "bangalore"),
    "Technology": ("computer", "software", "internet", "digital", "data", "system", "network"),
    "Health": ("health", "medical", "hospital", "doctor", "patient", "treatment", "disease"),
    "Transportation": ("car", "train", "bus", "flight", "transport", "vehicle", "travel"),
    "Weather": ("rain", "sunny", "cloud", "temperature", "climate", "weather", "storm"),
    "Environment": ("environment", "pollution", "forest", "green", "nature", "climate"),
}
DEFAULT_CATEGORY = "Other"
# -----------------------------------------------------------------------------------


def validate_category(category: Column | str, valid: tuple[str, ...] = CATEGORIES) -> Column:
    """Case-insensitive equality, else the first valid name that contains or is contained, else Other."""
    name = F.lower(F.trim(F.col(category) if isinstance(category, str) else category))
    exact = F.create_map(*[F.lit(x) for v in valid for x in (v.lower(), v)])
    partial = F.lit(DEFAULT_CATEGORY)
    for value in reversed(valid):
        low = value.lower()
        partial = F.when(F.lit(low).contains(name) | name.contains(low), F.lit(value)).otherwise(partial)
    return F.coalesce(exact[name], partial)


def categorize_by_rules(keyword: Column | str, rules: dict[str, tuple[str, ...]] = CATEGORY_SEED_WORDS) -> Column:
    """First category, in order, one of whose seed words occurs inside the keyword."""
    word = F.lower(F.col(keyword) if isinstance(keyword, str) else keyword)
    out = F.lit(DEFAULT_CATEGORY)
    for category, seeds in reversed(list(rules.items())):
        out = F.when(word.rlike("|".join(seeds)), F.lit(category)).otherwise(out)
    return out
