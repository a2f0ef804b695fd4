"""Checks of tables: duplicate keys, references, keys, row rules. Each is a DataFrame of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n_rows of keys that stand on more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, foreign: str, primary: str) -> DataFrame:
    """Rows of the child whose reference has no parent; null references too."""
    ids = parent.select(F.col(primary).alias("_parent")).distinct()
    return child.join(ids, child[foreign] == ids["_parent"], "left_anti")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows and problem ('null key' or 'duplicate key') of keys that a primary key would refuse."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.withColumn("problem", F.when(null, "null key").when(F.col("n_rows") > 1, "duplicate key")).filter(F.col("problem").isNotNull())


def required(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def one_of(column: str, values: list) -> Column:
    return ~F.coalesce(F.col(column).isin(values), F.lit(False))


def must_differ(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def identifier(column: str) -> Column:
    """Broken unless 1 to 64 of letters, digits, underscore and dollar, not beginning with a digit."""
    return ~F.coalesce(F.col(column).rlike(r"\A[A-Za-z_$][A-Za-z0-9_$]{0,63}\z"), F.lit(False))


def in_range(column: str, low: int, high: int) -> Column:
    return ~F.coalesce(F.col(column).between(low, high), F.lit(False))


def rule_violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule: one row for each rule that a row breaks. `rules` gives for each name when it is broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))
