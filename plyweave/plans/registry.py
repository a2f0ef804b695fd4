"""All registered queries of the library itself, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plyweave.plans import job_queries, sync_queries

Query = Callable[[SparkSession, str], DataFrame]

ENTRIES: dict[str, tuple[Query, str]] = sync_queries.ENTRIES | job_queries.ENTRIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items()}
