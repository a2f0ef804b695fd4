"""Merging a delta into a target by key, under a conflict policy; mirroring; replacing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyweave.sources.tables import connected

OVERWRITE, SKIP, ERROR = "overwrite", "skip", "error"


def policy_of(name: str | None) -> str:
    """The conflict policy: none or empty means overwrite, unknown ones are refused."""
    if not name:
        return OVERWRITE
    if name not in (OVERWRITE, SKIP, ERROR):
        raise ValueError(f"unknown conflict policy: {name}")
    return name


def same_schema(source: DataFrame, target: DataFrame) -> None:
    """Refuse to merge tables whose columns differ in name or type; their order may differ."""
    a, b = dict(source.dtypes), dict(target.dtypes)
    if a != b:
        raise ValueError(f"columns differ: {sorted(set(a.items()) ^ set(b.items()))}")


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, which fails when it is computed if a key is null: a null never matches and would be inserted again and again."""
    return df.withColumns({k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"key column {k} is null"))).otherwise(F.col(k)) for k in keys})


def latest_per_key(df: DataFrame, keys: list[str], order_by: str, tiebreak: list[str] | None = None) -> DataFrame:
    """The row with the largest `order_by` (then tiebreak, then its other columns but maps) of each key; nulls count as smallest.

    Each task keeps one row a key before the shuffle, so a key with very many versions is reduced first.
    """
    first = [order_by, *(tiebreak or [])]
    order = [*first, *(c for c, kind in df.dtypes if c not in (*first, *keys) and "map<" not in kind)]
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(f"`{c}`") for c in order])))
    return ranked.filter("_nth = 1").drop("_nth")


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, which fails when it is computed if a key stands on several rows: which of them counts would be left to chance.

    Only the keys are counted and shuffled, the rows stay where they are.
    """
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    several = F.raise_error(F.concat(F.lit("a key stands on "), F.col("n"), F.lit(" rows of the delta: order_by must tell the latest")))
    return df.filter(most.select(F.when(F.col("n") > 1, several.cast("boolean")).otherwise(F.lit(True)).alias("ok")).scalar())


def collisions(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the delta that the target has already."""
    return delta.select(*keys).distinct().join(target.select(*keys), keys, "left_semi")


def upsert(target: DataFrame, delta: DataFrame, keys: list[str], policy: str | None = OVERWRITE, order_by: str | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """The target with the delta merged in.

    overwrite: new keys are inserted, existing ones get the delta's row. skip: existing rows stay. error: any existing
    key raises ValueError with the number and a few of the keys, before anything is written. If the delta may hold
    several versions of a key, `order_by` keeps the latest; without it a repeated key is an error. Where all columns are keys, overwrite inserts what is absent.
    A small delta's keys are broadcast by the adaptive planner once their size is known; a large one is sort-merged.
    """
    policy = policy_of(policy)
    same_schema(delta, target)
    delta = with_keys(latest_per_key(delta, keys, order_by, tiebreak) if order_by else one_per_key(delta, keys), keys).select(target.columns)
    if policy == SKIP:
        return target.unionByName(delta.join(target.select(*keys), keys, "left_anti").select(target.columns))
    if policy == ERROR:
        hit = collisions(target, delta, keys)
        some = hit.limit(6).collect()
        if some:
            raise ValueError(f"{hit.count()} keys exist already, such as {[tuple(r) for r in some[:5]]}")
        return target.unionByName(delta)
    return delta.unionByName(target.join(delta.select(*keys), keys, "left_anti").select(target.columns))


def _differ(columns: list[str], a: str, b: str) -> Column:
    both = lambda side: F.struct(*[F.col(f"{side}.`{c}`") for c in columns])
    return ~both(a).eqNullSafe(both(b)) if columns else F.lit(False)


def mirror(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both by key with `action`: insert, update, delete or keep. Rows to delete have the target's values."""
    same_schema(source, target)
    s, t = with_keys(source, keys).withColumn("_s", F.lit(1)), target.withColumn("_t", F.lit(1))
    joined = s.alias("s").join(t.alias("t"), [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys], "full")
    rest = [c for c in target.columns if c not in keys]
    action = F.when(F.col("t._t").isNull(), "insert").when(F.col("s._s").isNull(), "delete").when(_differ(rest, "s", "t"), "update").otherwise("keep")
    values = [F.when(F.col("s._s").isNull(), F.col(f"t.`{c}`")).otherwise(F.col(f"s.`{c}`")).alias(c) for c in target.columns]
    return joined.select(*values, action.alias("action"))


def mirror_merge(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The target made equal to the source: inserted, updated and deleted by key."""
    return mirror(source, target, keys).filter("action <> 'delete'").drop("action")


def mirror_actions(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """action, n_rows."""
    return mirror(source, target, keys).groupBy("action").agg(F.count(F.lit(1)).alias("n_rows"))


def full_refresh(df: DataFrame, path: str, codec: str = "zstd", partition_by: list[str] | None = None) -> None:
    """Replace the table at `path` by `df`, schema included. `df` must not read `path`: see VersionedTable for that."""
    df.write.mode("overwrite").option("compression", codec).partitionBy(*(partition_by or [])).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 10_000, **options: str) -> None:
    """Insert the rows into a JDBC table, which is made if it isn't there; a key that exists is the database's error."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_rows), **options).mode("append").save()


def replace_content(spark: SparkSession, df: DataFrame, url: str, table: str, batch_rows: int = 10_000, **options: str) -> None:
    """Replace the content of a JDBC table by `df`, keeping the table's own definition, wholly or not at all.

    All tasks load a staging table; then one transaction empties the table and fills it from there. Whatever fails, the old
    rows stay, and readers never see a part of the new ones.
    """
    listed = ", ".join(df.columns)
    with staged(spark, df, url, table, batch_rows, **options) as staging:
        execute_jdbc(spark, url, [f"DELETE FROM {table}", f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging}"], **_login(options))


@contextmanager
def staged(spark: SparkSession, df: DataFrame, url: str, table: str, batch_rows: int = 10_000, index: list[str] | None = None, **options: str) -> Iterator[str]:
    """Load `df` from all tasks into a new table beside `table` and give its name; it is dropped at the end.

    `index`: columns by which it is looked up; it gets an index on them, where the database can have one on their types.

    Its name is new each time, so it meets no other table and no other load. What goes wrong is raised as it is: that the
    staging table can't be dropped then (as when it was never made) is only noted with it.
    """
    staging, login = f"{table.rpartition('.')[0]}.stage_{uuid.uuid4().hex[:20]}".lstrip("."), _login(options)
    try:
        df.write.format("jdbc").options(url=url, dbtable=staging, batchsize=str(batch_rows), **options).mode("error").save()
        if index:
            with suppress(Exception):  # without it the merge takes longer
                execute_jdbc(spark, url, [f"CREATE INDEX {staging}_k ON {staging} ({', '.join(index)})"], **login)
        yield staging
    except BaseException as error:
        try:
            execute_jdbc(spark, url, [f"DROP TABLE {staging}"], **login)
        except Exception:  # noqa: BLE001  what went wrong first counts
            error.add_note(f"{staging} could not be dropped")
        raise
    execute_jdbc(spark, url, [f"DROP TABLE {staging}"], **login)


def _login(options: dict[str, str]) -> dict[str, str]:
    return {k: options[k] for k in ("user", "password") if k in options}


def upsert_partitions(spark: SparkSession, path: str, delta: DataFrame, keys: list[str], partition_by: list[str], policy: str | None = OVERWRITE, order_by: str | None = None, tiebreak: list[str] | None = None) -> None:
    """Upsert into a partitioned Parquet table by rewriting only the partitions that the delta touches.

    `partition_by` must follow from the keys (as a bucket of one does), so that a key never changes its partition; nulls in it are refused. The
    list of touched partitions is bounded by how many the table has. An untouched partition is neither read nor written.
    Partitions are overwritten in place, each of its own: a reader may see some of them new and others old, and a failure while
    they are moved leaves them so (a repeated call mends that). VersionedTable with keys and buckets changes as a whole.
    """
    delta = with_keys(delta, partition_by)
    touched = delta.select(*partition_by).distinct().collect()
    if not touched:
        return
    whole = spark.read.schema(delta.schema).parquet(path)  # else a partition's type would be guessed from its name
    for c in partition_by:  # prunes the scan
        whole = whole.filter(F.col(c).isin([row[c] for row in touched]))
    if len(partition_by) > 1:
        whole = whole.join(delta.select(*partition_by).distinct(), partition_by, "left_semi")
    merged = upsert(whole, delta, keys, policy, order_by, tiebreak)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


class OtherRows(RuntimeError):
    """A statement has changed more or fewer rows than it must."""


def execute_jdbc(spark: SparkSession, url: str, statements: list[str | tuple[str, int]], user: str | None = None, password: str | None = None, refuse: str | None = None) -> None:
    """Run statements in one transaction, over one connection of the driver.

    A statement may come with the number of rows that it must change, else OtherRows. `refuse` is a query that gives one number, asked first in
    the same transaction: unless it is zero, ValueError. After any error nothing is changed.
    """
    with connected(spark, url, user, password) as connection:
        connection.setAutoCommit(False)
        try:
            if refuse:
                rows = connection.createStatement().executeQuery(refuse)
                rows.next()
                n = rows.getLong(1)
                rows.close()
                if n:
                    raise ValueError(f"{n} keys exist already")
            for wanted in statements:
                text, n = wanted if isinstance(wanted, tuple) else (wanted, None)
                statement = connection.createStatement()
                statement.execute(text)
                if n is not None and statement.getUpdateCount() != n:
                    raise OtherRows(text)
                statement.close()
            connection.commit()
        except BaseException:
            connection.rollback()
            raise


def merge_statement(url: str, table: str, staging: str, columns: list[str], keys: list[str], policy: str) -> str:
    """SQL that merges a staging table into a table: standard MERGE, or MySQL's own form, which needs a unique index on the keys."""
    rest, listed = [c for c in columns if c not in keys], ", ".join(columns)
    if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")):
        change = ", ".join(f"{c} = VALUES({c})" for c in (rest if policy == OVERWRITE and rest else keys[:1]))
        return f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} ON DUPLICATE KEY UPDATE {change}"
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in rest)}" if policy == OVERWRITE and rest else ""
    return f"MERGE INTO {table} t USING {staging} s ON {equal_keys(keys)}{update} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{c}' for c in columns)})"


def upsert_jdbc(spark: SparkSession, delta: DataFrame, url: str, table: str, keys: list[str], policy: str | None = OVERWRITE, order_by: str | None = None, tiebreak: list[str] | None = None, batch_rows: int = 10_000, **options: str) -> None:
    """Upsert into a JDBC table: all tasks load a staging table, then the database merges it by one statement, in one transaction.

    Policies and repeated keys are as in `upsert`; under `error` that transaction asks first for keys that exist. A failed
    load leaves the table as it was; the staging table is dropped in any case. Column names are those of the table.
    """
    policy = policy_of(policy)
    delta = with_keys(latest_per_key(delta, keys, order_by, tiebreak) if order_by else one_per_key(delta, keys), keys).select(delta.columns)
    with staged(spark, delta, url, table, batch_rows, keys, **options) as staging:
        there = f"SELECT COUNT(*) FROM {table} t JOIN {staging} s ON {equal_keys(keys)}" if policy == ERROR else None
        execute_jdbc(spark, url, [merge_statement(url, table, staging, delta.columns, keys, policy)], **_login(options), refuse=there)


def mirror_jdbc(spark: SparkSession, source: DataFrame, url: str, table: str, keys: list[str], batch_rows: int = 10_000, **options: str) -> None:
    """Make a JDBC table equal to `source` by its keys: missing rows are deleted, others merged, in one transaction after a staging load.

    Null and repeated keys are errors. Rows of the table with a null key have no row in the source, so they go.
    """
    rows = with_keys(one_per_key(source, keys), keys).select(source.columns)
    with staged(spark, rows, url, table, batch_rows, keys, **options) as staging:
        there = " AND ".join(f"s.{k} = {table}.{k}" for k in keys)
        missing = f"DELETE FROM {table} WHERE NOT EXISTS (SELECT 1 FROM {staging} s WHERE {there})"
        execute_jdbc(spark, url, [missing, merge_statement(url, table, staging, rows.columns, keys, OVERWRITE)], **_login(options))


def equal_keys(keys: list[str]) -> str:
    return " AND ".join(f"t.{k} = s.{k}" for k in keys)


def merge_into(delta: DataFrame, table: str, keys: list[str], policy: str | None = OVERWRITE, order_by: str | None = None, tiebreak: list[str] | None = None) -> None:
    """Upsert into a catalog table whose source takes row-level merges, which rewrites only the files that hold the delta's keys.

    Policies and repeated keys are as in `upsert`; `error` asks the table for the keys first.
    """
    policy, spark = policy_of(policy), delta.sparkSession
    delta = with_keys(latest_per_key(delta, keys, order_by, tiebreak) if order_by else one_per_key(delta, keys), keys)
    if policy == ERROR and (n := collisions(spark.table(table), delta, keys).count()):
        raise ValueError(f"{n} keys exist already")
    merge = delta.alias("_delta").mergeInto(table, _matched(table, keys))
    merge = merge.whenMatched().updateAll() if policy == OVERWRITE else merge
    merge.whenNotMatched().insertAll().merge()


def mirror_into(source: DataFrame, table: str, keys: list[str]) -> None:
    """Make a catalog table whose source takes row-level merges equal to `source`: rows that differ are updated, new ones inserted, others deleted."""
    differ = F.lit(False)
    for c in source.columns:
        differ = differ if c in keys else differ | ~F.col(f"{table}.{c}").eqNullSafe(F.col(f"_delta.{c}"))
    rows = with_keys(one_per_key(source, keys), keys)
    rows.alias("_delta").mergeInto(table, _matched(table, keys)).whenMatched(differ).updateAll().whenNotMatched().insertAll().whenNotMatchedBySource().delete().merge()


def _matched(table: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"{table}.{k}") == F.col(f"_delta.{k}"))
    return on
