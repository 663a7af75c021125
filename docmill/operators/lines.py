"""Operators over the lines of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import collapsed_runs


def collapse_runs(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, lines, text: runs of equal short lines become one line with their number. Per row, no shuffle."""
    return df.select(key, collapsed_runs(F.col(text_col)).alias("text")).select(key, F.size(F.split("text", "\n")).cast("long").alias("lines"), "text")
