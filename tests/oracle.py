"""Rows of a registered query, from Spark and from DuckDB, in a form that compares."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, float | int) and not isinstance(v, bool):
            return "None" if pd.isna(v) else f"{v:.9g}"
        return "None" if v is None or v is pd.NaT or v is pd.NA else str(v)

    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.execute(sql).fetchdf()


def agree(spark, query, sql: str, sf: str = SF) -> None:
    got, want = query(spark, sf).toPandas(), duck(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
