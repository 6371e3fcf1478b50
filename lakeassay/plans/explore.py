"""Looking through findings and columns that are already tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_findings(df: DataFrame, severity: str | None = None, category: str | None = None, search: str | None = None) -> DataFrame:
    """Findings of a severity and category whose id, title, description or columns contain a text, in any case."""
    if severity:
        df = df.where(F.col("severity") == severity)
    if category:
        df = df.where(F.col("category") == category)
    if search:
        s = search.lower()
        hit = F.exists("affected_columns", lambda c: F.lower(c).contains(s))
        for c in ("id", "title", "description"):
            if c in df.columns:
                hit = hit | F.lower(F.col(c)).contains(s)
        df = df.where(hit)
    return df


def filter_columns(df: DataFrame, name: str | None = None, semantic_type: str | None = None, search: str | None = None) -> DataFrame:
    """Column profiles of a name and a role whose name or type contains a text, in any case."""
    if name:
        df = df.where(F.col("name") == name)
    if semantic_type:
        df = df.where(F.col("semantic_type") == semantic_type)
    if search:
        df = df.where(F.lower("name").contains(search.lower()) | F.lower("inferred_dtype").contains(search.lower()))
    return df
