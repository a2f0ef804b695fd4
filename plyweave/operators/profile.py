"""Profiles of tables: per column and per table, each in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """position, column, type, n_nulls, max_length (strings; else null), n_distinct of each column.

    n_distinct is a sketch's estimate, or exact on request (which shuffles every distinct value).
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    rows, aggregates = [], []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, T.StringType)
        aggregates += [F.count_if(c.isNull()).alias(f"n{i}"), distinct(c).alias(f"d{i}")] + ([F.max(F.length(c)).alias(f"l{i}")] if text else [])
        length = F.col(f"l{i}").cast("long") if text else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("n_nulls"), length.alias("max_length"), F.col(f"d{i}").alias("n_distinct")))
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def table_stats(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """table, n_rows, n_null_cells, last_value (the largest tracking value as text) of each named (table, tracking column)."""

    def one(name: str, df: DataFrame, tracking: str | None) -> DataFrame:
        nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
        last = F.max(f"`{tracking}`").cast("string") if tracking else F.lit(None).cast("string")
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_null_cells"), last.alias("last_value")).select(F.lit(name).alias("table"), "*")

    return reduce(DataFrame.unionByName, [one(name, df, tracking) for name, (df, tracking) in tables.items()])
