"""Cleaning of strings for targets that hold the basic multilingual plane only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_supplementary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop code points from U+10000 on (emoji and others) from all string columns, or those named. Null stays null."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.regexp_replace(F.col(f"`{c}`"), r"[\x{10000}-\x{10FFFF}]", "") for c in names})
