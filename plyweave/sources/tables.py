"""Reading: whole tables, partitioned JDBC reads, counts and ordered pages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a page: if none are asked for, and at most.
PAGE, MOST = 100, 1000


def predicate(where: str | None) -> Column:
    """The user's SQL filter as one parenthesised predicate; none or blank keeps all rows."""
    return F.expr(f"({where})") if where and where.strip() else F.lit(True)


def read_table(spark: SparkSession, source: str, where: str | None = None, columns: list[str] | None = None, file_format: str | None = None, **options: str) -> DataFrame:
    """A catalog table, or files of `file_format` at a path, filtered. Filter and column choice reach the scan."""
    df = spark.read.format(file_format).options(**options).load(source) if file_format else spark.read.table(source)
    df = df.filter(predicate(where)) if where else df
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | list[str] | None = None, where: str | None = None, partitions: int = 16, fetch_rows: int = 10_000, **options: str) -> DataFrame:
    """A JDBC table, read in parallel by ranges of a key, one or several columns of any types that the database can compare.

    The ranges have about equally many rows, however the keys are spread (`split_points`). They leave nothing out and
    don't overlap: rows that come meanwhile are in one of them, rows with a null key in the first.
    """
    keys = [key] if isinstance(key, str) else key or []
    login = {k: options[k] for k in ("user", "password") if k in options}
    bounds = split_points(spark, url, table, keys, partitions, **login) if keys else []
    options |= {"fetchsize": str(fetch_rows)}
    if bounds:
        df = spark.read.jdbc(url, table, predicates=range_predicates(keys, bounds), properties=options)
    else:
        df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.filter(predicate(where)) if where else df


@contextmanager
def connected(spark: SparkSession, url: str, user: str | None = None, password: str | None = None) -> Iterator:
    """One connection of the driver."""
    manager = spark._jvm.java.sql.DriverManager
    connection = manager.getConnection(url) if user is None else manager.getConnection(url, user, password)
    try:
        yield connection
    finally:
        connection.close()


#: How databases write a random number from 0 to 1, by the beginning of their url; the others: RAND().
_RANDOM = {"jdbc:derby:": "RANDOM()", "jdbc:postgresql:": "RANDOM()", "jdbc:oracle:": "DBMS_RANDOM.VALUE"}
#: Sampled keys for each range: their share of rows is off by a tenth, seldom by more than a third.
SAMPLED = 200


def split_points(spark: SparkSession, url: str, table: str, keys: list[str], partitions: int, user: str | None = None, password: str | None = None) -> list[tuple[str, ...]]:
    """Up to partitions - 1 different keys, in order, that cut the table into ranges of about equally many rows, as SQL literals.

    The database draws a sample of at most about SAMPLED keys a range and sorts it, so the order is its own, whatever its collation.
    A single key value is never cut, however many rows have it.
    """
    random = next((r for start, r in _RANDOM.items() if url.startswith(start)), "RAND()")
    listed = ", ".join(keys)
    there = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    with connected(spark, url, user, password) as connection:
        count = connection.createStatement().executeQuery(f"SELECT COUNT(*) FROM {table}")
        count.next()
        n = count.getLong(1)
        if partitions < 2 or n < 2:
            return []
        share = min(1.0, SAMPLED * partitions / n)
        drawn = f" AND {random} < {share:.12f}" if share < 1 else ""
        rows = connection.createStatement().executeQuery(f"SELECT {listed} FROM {table} WHERE {there}{drawn} ORDER BY {listed}")
        kinds = [rows.getMetaData().getColumnType(i + 1) for i in range(len(keys))]
        sample = []
        while rows.next():
            sample.append(tuple(_literal(rows.getString(i + 1), kind, url) for i, kind in enumerate(kinds)))
    cuts = [sample[len(sample) * i // partitions] for i in range(1, partitions)] if sample else []
    return [c for c in dict.fromkeys(cuts) if c != sample[0]]


# Numbers of JDBC's types.
_NUMBERS, _DATE, _TIME, _TIMESTAMPS = {-7, -6, -5, 2, 3, 4, 5, 6, 7, 8}, 91, 92, {93, 2014}


def _literal(text: str, kind: int, url: str) -> str:
    if kind in _NUMBERS:
        return text
    if kind == _DATE or kind == _TIME or kind in _TIMESTAMPS:
        return f"{{{'d' if kind == _DATE else 't' if kind == _TIME else 'ts'} '{text}'}}"
    return literal_text(text, url)


def literal_text(text: str, url: str) -> str:
    """A text as SQL of the database at `url`."""
    text = text.replace("\\", "\\\\") if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")) else text
    return "'" + text.replace("'", "''") + "'"


def _below(keys: list[str], bound: tuple[str, ...]) -> str:
    """Whether the keys, compared one after the other, are less than the bound: a predicate that any database takes."""
    less = f"{keys[0]} < {bound[0]}"
    return less if len(keys) == 1 else f"({less} OR ({keys[0]} = {bound[0]} AND {_below(keys[1:], bound[1:])}))"


def range_predicates(keys: list[str], bounds: list[tuple[str, ...]]) -> list[str]:
    """For each range a predicate; every row passes exactly one. Rows with a null among the keys are in the first."""
    nulls, there = " OR ".join(f"{k} IS NULL" for k in keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
    out = [f"({nulls} OR {_below(keys, bounds[0])})"]
    for low, high in zip(bounds, [*bounds[1:], None], strict=True):
        out.append(f"({there} AND NOT {_below(keys, low)}" + (f" AND {_below(keys, high)})" if high else ")"))
    return out


def row_count(df: DataFrame, where: str | None = None) -> DataFrame:
    """One row: n_rows, the rows that pass the filter."""
    return df.filter(predicate(where)).agg(F.count(F.lit(1)).alias("n_rows"))


def preview(df: DataFrame, keys: list[str], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page in key order: limits below 1 become 100, above 1000 become 1000, negative offsets 0; binary shows as text."""
    limit = PAGE if limit <= 0 else min(limit, MOST)
    shown = [F.col(c).cast("string").alias(c) if kind == "binary" else F.col(c) for c, kind in df.dtypes]
    return df.orderBy(*keys).offset(max(offset, 0)).limit(limit).select(*shown)
