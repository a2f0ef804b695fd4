from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plyweave.functions import errors
from plyweave.functions.clean import strip_supplementary
from plyweave.operators import jobs, profile, quality
from plyweave.sources import tables

NOW = dt.datetime(2024, 1, 31)


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("Lock wait timeout exceeded", ("lock_timeout", "medium", True)),
        ("dial tcp: CONNECTION REFUSED", ("connection", "high", True)),
        ("Access denied for user", ("authentication", "critical", False)),
        ("context deadline exceeded", ("timeout", "medium", True)),
        ("Table doesn't exist", ("schema_conflict", "high", False)),
        ("Incorrect integer value", ("data_conversion", "medium", False)),
        ("Duplicate entry", ("primary_key_conflict", "low", False)),
        ("No space left on device", ("disk_space", "critical", False)),
        ("cannot allocate memory", ("system_resource", "critical", False)),
        ("hm", ("unknown", "medium", True)),
    ],
)
def test_error_classes(spark, message, want):
    row = spark.range(1).select(errors.classify(F.lit(message)).alias("e"), errors.stops_job(F.lit(message)).alias("stop")).first()
    assert (tuple(row["e"]), row["stop"]) == (want, want[1] == "critical")


def test_null_message_has_no_class(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "deadlock", "t")], "id int, message string, table string")
    assert [r["type"] for r in errors.error_classes(df).orderBy("id").collect()] == [None, "lock_timeout"]
    assert errors.error_report(df, "table").count() == 1


def test_strip_supplementary(spark):
    df = spark.createDataFrame([("a😀b中", 1, "x"), (None, 2, "😀￿")], "s string, n int, t string")
    assert [tuple(r) for r in strip_supplementary(df).collect()] == [("ab中", 1, "x"), (None, 2, "￿")]


def test_key_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (3, None)], "a int, b int")
    assert sorted((r["problem"], r["n_rows"]) for r in quality.key_violations(df, ["a", "b"]).collect()) == [("duplicate key", 2), ("null key", 1), ("null key", 1)]
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    assert quality.orphans(df, parent, "a", "id").count() == 2


def test_rules(spark):
    df = spark.createDataFrame([(1, "ok_1", 80), (2, "1bad", 0), (3, None, None), (4, "x" * 65, 65536), (5, "abc\n", 1)], "id int, name string, port int")
    got = quality.rule_violations(df, ["id"], {"name": quality.identifier("name"), "port": quality.in_range("port", 1, 65535), "blank": quality.required("name")})
    assert sorted(map(tuple, got.collect())) == [(2, "name"), (2, "port"), (3, "blank"), (3, "name"), (3, "port"), (4, "name"), (4, "port"), (5, "name")]


def job(i, status, minutes, end=None, rows=0, tables_=0):
    start = NOW - dt.timedelta(minutes=minutes)
    return (i, status, start, start, end, tables_, tables_, 0, rows, None)


JOBS = "id int, status string, start_time timestamp_ntz, created_at timestamp_ntz, end_time timestamp_ntz, total_tables int, completed_tables int, total_rows long, processed_rows long, error string"


def test_statistics_of_two_jobs(spark):
    df = spark.createDataFrame([job(1, "completed", 60, NOW, 1000, 2), job(2, "failed", 30, NOW, 500, 1)], JOBS)
    row = jobs.sync_statistics(df, F.lit(NOW)).first()
    assert (row["total_jobs"], row["total_rows"], row["total_tables"], row["error_rate"], row["average_minutes"]) == (2, 1500, 3, 50.0, 90.0)
    empty = jobs.sync_statistics(df.limit(0), F.lit(NOW)).first()
    assert (empty["total_jobs"], empty["average_minutes"], empty["error_rate"]) == (0, None, None)


def test_stuck_at_the_boundary(spark):
    df = spark.createDataFrame([job(1, "running", 30), job(2, "running", 31), job(3, "failed", 99)], JOBS)
    assert [r["id"] for r in jobs.stuck_jobs(df, F.lit(NOW)).collect()] == [2]
    fixed = {r["id"]: r for r in jobs.repair_stuck(df, F.lit(NOW)).collect()}
    assert (fixed[2]["status"], fixed[2]["end_time"], fixed[1]["status"]) == ("failed", NOW, "running")
    assert fixed[2]["error"] == "Task timeout - automatically marked as failed after 30 minutes. Original error: none"


def test_pending_expire_after_a_day(spark):
    df = spark.createDataFrame([job(1, "pending", 1440), job(2, "pending", 1441)], JOBS)
    assert {r["id"]: r["action"] for r in jobs.expire_pending(df, F.lit(NOW)).collect()} == {1: "resubmit", 2: "expire"}


def test_progress_falls_back_to_tables(spark):
    df = spark.createDataFrame([(1, 50, 200, 1, 4), (2, 0, 0, 1, 4), (3, 0, 0, 0, 0)], "id int, pr int, tr int, ct int, tt int")
    got = df.select("id", jobs.progress(F.col("pr"), F.col("tr"), F.col("ct"), F.col("tt")).alias("p"))
    assert [r["p"] for r in got.orderBy("id").collect()] == [25.0, 25.0, 0.0]


def test_preview_bounds(spark):
    df = spark.range(2000).select("id", F.lit(b"ab").alias("b"))
    assert tables.preview(df, ["id"], -5, 0).count() == 100
    assert tables.preview(df, ["id"], 0, 5000).count() == 1000
    assert tuple(tables.preview(df, ["id"], 3, 1).first()) == (3, "ab")


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1, "ab"), (1, None), (None, "abc")], "n int, `odd name` string")
    assert [tuple(r) for r in profile.column_profile(df, True).collect()] == [(1, "n", "int", 1, None, 1), (2, "odd name", "string", 1, 3, 2)]


def test_jdbc_is_read_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(1500).select(F.col("id").cast("int").alias("K"), F.col("id").cast("string").alias("V")).write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    df = tables.read_jdbc(spark, url, "T", "K", "K >= 100", partitions=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert (df.count(), df.rdd.getNumPartitions()) == (1400, 4)
    assert "GreaterThanOrEqual(K,100)" in df._jdf.queryExecution().executedPlan().toString()
