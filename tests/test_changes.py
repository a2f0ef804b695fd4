from __future__ import annotations

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyweave.operators import changes
from plyweave.operators.merge import upsert
from plyweave.plans import run
from plyweave.sources.versioned import Conflict, VersionedTable
from plyweave.streaming.continuous import continuous_sync, merge_batch, take_batch

SCHEMA = "id long, v string, updated_at timestamp_ntz"
DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def schema(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


def test_tracking_rule():
    text, time = T.StringType(), T.TimestampType()
    assert changes.tracking_column(schema(("modified_at", text), ("updated_at", text))) == ("updated_at", "ts")
    assert changes.tracking_column(schema(("my_update_ts", time), ("update_time", text))) == ("my_update_ts", "ts")
    assert changes.tracking_column(schema(("my_update", text), ("n", text)), "n") == ("n", "id")
    with pytest.raises(ValueError, match="no tracking column"):
        changes.tracking_column(schema(("a", text)))


def test_marks_parse():
    assert [changes.parse_id_mark(x) for x in ("12", "", None, "x", " 7 ")] == [12, 0, 0, 0, 7]


def test_pull_excludes_nulls_and_respects_or(spark):
    df = spark.createDataFrame([(1, "a", DAY[0]), (2, "b", DAY[1]), (3, "c", None), (4, "d", DAY[3])], SCHEMA)
    got = changes.pull_changes(df, "updated_at", F.lit(DAY[0]), F.lit(DAY[2]), "v = 'a' OR v = 'b'")
    assert [r["id"] for r in got.collect()] == [2]


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = changes.pull_changes(df, "event_id", F.lit(10), F.lit(20)).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,10)" in plan and "LessThanOrEqual(event_id,20)" in plan
    assert "ReadSchema: struct<event_id:bigint>" in plan


def test_rounds(spark, tmp_path):
    target, marks = VersionedTable(spark, f"{tmp_path}/t"), changes.Checkpoints(spark, f"{tmp_path}/c")
    go = lambda rows, **kw: changes.incremental_sync(spark.createDataFrame(rows, SCHEMA), target, ["id"], marks, "m", **kw)
    rows = lambda: sorted((r["id"], r["v"]) for r in target.current().collect())
    first = [(1, "a", DAY[0]), (2, "b", DAY[1])]
    assert go(first).mode == "full"
    assert go(first).n_rows == 0
    later = [(1, "A", DAY[2]), (2, "b", DAY[1]), (3, "c", DAY[2])]
    assert (go(later).n_rows, rows()) == (2, [(1, "A"), (2, "b"), (3, "c")])
    late = [*later, (4, "late", DAY[1])]
    assert (go(late).n_rows, len(rows())) == (0, 3)
    assert (go(late, overlap="2 days").n_rows, len(rows())) == (4, 4)
    assert (go([(1, "Z", DAY[4])], policy="skip").n_rows, rows()[0]) == (1, (1, "A"))
    with pytest.raises(ValueError, match="keys exist already"):
        go([(1, "Y", DAY[5])], policy="error")
    assert marks.get("m")["hi_ts"] == DAY[4]
    assert marks.all().count() == 1


def test_ties_and_versions_are_deterministic(spark, tmp_path):
    rows = [(1, "a", DAY[0]), (1, "b", DAY[0]), (2, "x", DAY[0]), (2, "y", None)]
    for n in range(3):
        target, marks = VersionedTable(spark, f"{tmp_path}/t{n}"), changes.Checkpoints(spark, f"{tmp_path}/c{n}")
        changes.incremental_sync(spark.createDataFrame(rows[n:] + rows[:n], SCHEMA), target, ["id"], marks, "m")
        later = [(1, "p", DAY[2]), (1, "q", DAY[2])]
        changes.incremental_sync(spark.createDataFrame(later[::-1] if n else later, SCHEMA), target, ["id"], marks, "m")
        assert sorted((r["id"], r["v"]) for r in target.current().collect()) == [(1, "q"), (2, "x")]


def test_buckets_without_changes_keep_their_files(spark, tmp_path):
    target, marks = VersionedTable(spark, f"{tmp_path}/t", ["id"], 8), changes.Checkpoints(spark, f"{tmp_path}/c")
    first = [(i, "old", DAY[0]) for i in range(200)]
    changes.incremental_sync(spark.createDataFrame(first, SCHEMA), target, ["id"], marks, "m")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    delta = [(7, "new", DAY[1]), (1000, "new", DAY[1])]
    assert changes.incremental_sync(spark.createDataFrame(delta, SCHEMA), target, ["id"], marks, "m").n_rows == 2
    rows = {r["id"]: r["v"] for r in target.current().collect()}
    assert rows == {i: "old" for i in range(200)} | {7: "new", 1000: "new"}
    last = target.commits().filter("version = 1").collect()
    assert len(last) == 8 and sum(r["path"].split("/")[1] in str(f) for r in last for f in before if f"/{r['path']}/" in str(f)) >= 6
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    assert target.vacuum(1) == 1
    assert {r["id"]: r["v"] for r in target.current().collect()} == rows
    left = {f for f in before if f.exists()}
    assert 0 < len(left) <= len(before)
    target.publish(spark.createDataFrame(first[:3], SCHEMA))
    target.vacuum(1)
    assert target.current().count() == 3 and not any(f.exists() for f in before)


def test_two_writers_of_one_version(spark, tmp_path):
    target = VersionedTable(spark, f"{tmp_path}/t")
    target.publish(spark.range(3))

    def meanwhile(now):
        VersionedTable(spark, f"{tmp_path}/t").publish(spark.range(5))
        return now.union(spark.range(3, 4))

    with pytest.raises(Conflict):
        target.merge(spark.range(3, 4), lambda now, _: meanwhile(now))
    assert target.current().count() == 5


def test_stream_keeps_rows_with_a_later_tiebreak(spark):
    schema = "k int, ts int, id int"
    target, late = spark.createDataFrame([(1, 5, 9)], schema), spark.createDataFrame([(1, 5, 3)], schema)
    assert merge_batch(target, late, ["k"], "ts", ["id"], only_newer=True).first()[:] == (1, 5, 9)


def test_failed_write_keeps_the_old_version(spark, tmp_path):
    target = VersionedTable(spark, f"{tmp_path}/t")
    assert target.current() is None
    target.publish(spark.range(3))
    with pytest.raises(Exception, match="boom"):
        target.publish(spark.range(3).select(F.raise_error(F.lit("boom")).cast("long").alias("id")))
    assert target.current().count() == 3
    target.update(lambda now: now.union(spark.range(3, 5)))
    assert (target.current().count(), target.commits().count()) == (5, 2)


def test_plan_resumes_and_stops(spark, tmp_path):
    rows = [("a", "s1", "t1", "full", ["id"], None, True, 1), ("b", "denied", "t2", "full", ["id"], None, True, 2), ("c", "s1", "t3", "full", ["id"], "id > 1", True, 3)]
    plan = spark.createDataFrame(rows, "mapping_id string, source_table string, target_table string, sync_mode string, keys array<string>, where_clause string, enabled boolean, sort_order int").withColumn("created_at", F.lit(DAY[0]))

    def read(name):
        if name == "denied":
            raise PermissionError("Access denied for user")
        return spark.range(4)

    one = run.sync_tables(plan, read, str(tmp_path), "r")
    assert sorted((r["mapping_id"], r["status"]) for r in one.collect()) == [("a", "completed"), ("b", "failed")]  # critical: c isn't tried
    two = run.sync_tables(plan, lambda name: spark.range(4), str(tmp_path), "r")
    assert sorted((r["mapping_id"], r["status"], r["n_rows"]) for r in two.collect()) == [("a", "completed", 4), ("b", "completed", 4), ("b", "failed", 0), ("c", "completed", 2)]


def test_copy_metrics(spark, tmp_path):
    seen = run.copy_metrics(spark.range(10), lambda df: df.write.parquet(f"{tmp_path}/x"), "id < 7")
    assert (seen["total_rows"], seen["processed_rows"], seen["filtered_rows"]) == (10, 7, 3)
    # spark.range(10) has four partitions of two or three rows; the last has none that pass.
    assert (seen["failed_rows"], seen["batches"], seen["error"]) == (0, 4, None)
    assert [(t["task"], t["status"], t["rows"]) for t in seen["tasks"]] == [(0, "SUCCESS", 2), (1, "SUCCESS", 3), (2, "SUCCESS", 2), (3, "SUCCESS", 0)]
    assert 0 < seen["seconds_per_batch"] == sum(t["seconds"] for t in seen["tasks"]) / 4


def test_a_copy_of_which_a_task_fails(spark, tmp_path):
    """One of four tasks fails: its rows are told apart, and what the others have written is counted."""
    df = spark.range(0, 4000, 1, 4).withColumn("x", F.when((F.col("id") >= 2000) & (F.col("id") < 3000), F.raise_error(F.lit("boom")).cast("int")))
    path = f"{tmp_path}/x"
    seen = run.copy_metrics(df, lambda rows: rows.write.parquet(path), "id % 10 <> 0", "id")
    lost = [t for t in seen["tasks"] if t["status"] == "FAILED"]
    assert [(t["task"], t["failed_rows"], t["first_key"], t["last_key"]) for t in lost] == [(2, 900, 2001, 2999)]
    assert "boom" in lost[0]["error"] and "boom" in seen["error"]
    assert (seen["total_rows"], seen["filtered_rows"], seen["processed_rows"] + seen["failed_rows"]) == (4000, 400, 3600)
    assert seen["failed_rows"] >= 900 and seen["batches"] == sum(t["status"] == "SUCCESS" for t in seen["tasks"])


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    path, rows = f"{tmp_path}/t", spark.range(100).withColumn("v", F.lit("old"))
    VersionedTable(spark, path, ["id"], 16).publish(rows)
    delta = rows.filter("id < 6").withColumn("v", F.lit("new"))
    take = lambda table: table.merge(delta, lambda now, d: upsert(now, d, ["id"]))
    for other in (VersionedTable(spark, path, ["id"], 8), VersionedTable(spark, path, ["v"], 16), VersionedTable(spark, path, ["id"], 16, "range")):
        with pytest.raises(ValueError, match="redeal"):
            take(other)
    assert take(VersionedTable(spark, path)) == 6  # as it is dealt
    assert (VersionedTable(spark, path).current().count(), VersionedTable(spark, path).current().filter("v = 'new'").count()) == (100, 6)
    eight = VersionedTable(spark, path, ["id"], 8)
    eight.redeal()
    take(eight)
    assert eight.current().count() == 100 and len(eight._last()[2]) == 8


def used_files(tmp_path, table):
    """Sizes of the data files of a version, and of all there are."""
    return {f: f.stat().st_size for r in table._last()[2] for f in (tmp_path / "t" / r["path"]).rglob("*.parquet")}


@pytest.mark.parametrize("key", ["id", "name", "at"])
def test_recent_keys_touch_few_ranges(spark, tmp_path, key):
    df = spark.range(20_000).select("id", F.format_string("n%08d", "id").alias("name"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table = VersionedTable(spark, f"{tmp_path}/t", [key], 64, "range")
    table.publish(df.filter("id < 19800"))
    before = used_files(tmp_path, table)
    assert len(table._last()[2]) > 50
    delta = df.filter("id >= 19790").withColumn("v", F.lit("new"))
    assert table.merge(delta, lambda now, d: upsert(now, d, [key])) == 210
    after = used_files(tmp_path, table)
    written = sum(size for f, size in after.items() if f not in before)
    assert written < 0.05 * sum(after.values())
    rows = {r["id"]: r["v"] for r in table.current().select("id", "v").collect()}
    assert len(rows) == 20_000 and sum(v == "new" for v in rows.values()) == 210
    # A range that grows is cut; those before it stay.
    more = df.withColumns({"id": F.col("id") + 20_000, "name": F.format_string("n%08d", F.col("id") + 20_000), "at": F.timestamp_seconds((F.col("id") + 20_000) * 60)}).filter("id < 22000")
    table.merge(more, lambda now, d: upsert(now, d, [key]))
    sizes = sorted(r["n_rows"] for r in table._last()[2])
    assert sum(sizes) == 22_000 and sizes[-1] <= 2 * 310 * 1.5 and len(sizes) > 57
    lows = table.commits().filter(F.col("version") == 2).select("low", "high").collect()
    assert len(lows) == len(sizes) and all(r["low"] is not None and r["high"] is not None for r in lows)
    table.merge(df.filter("id = 5").withColumn("v", F.lit("x")), lambda now, d: upsert(now, d, [key]))
    assert table.current().count() == 22_000 and table.current().filter("v = 'x'").count() == 1


def test_ranges_of_floats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="can't be dealt by ranges"):
        VersionedTable(spark, f"{tmp_path}/t", ["x"], 4, "range").publish(spark.range(9).selectExpr("id / 2.5e0 AS x"))


@pytest.mark.parametrize("by", ["hash", "range"])
def test_mirror_writes_what_differs(spark, tmp_path, by):
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("t")).alias("t"))
    table = VersionedTable(spark, f"{tmp_path}/t", ["id"], 20, by)
    table.publish(df)
    assert table.mirror(df.repartition(3)) == {"keep": 2000} and table._numbers() == [0]
    before = used_files(tmp_path, table)
    source = df.filter("id <> 11").withColumn("v", F.when(F.col("id") == 13, 99).otherwise(F.col("v"))).union(spark.range(5000, 5001).selectExpr("id", "1L", "'n'"))
    assert table.mirror(source) == {"keep": 1998, "update": 1, "delete": 1, "insert": 1}
    assert sorted(map(tuple, table.current().collect())) == sorted(map(tuple, source.collect()))
    kept = [f for f in used_files(tmp_path, table) if f in before]
    assert len(before) - 3 <= len(kept) < len(before)
    # Values that move between columns, and whole buckets that go.
    assert table.mirror(source.filter("id < 100"))["delete"] == 1901
    assert table.current().count() == 99
    assert table.mirror(source.limit(0)) == {"delete": 99}
    assert table.current().count() == 0 and table.current().columns == ["id", "v", "t"]
    assert table.mirror(source)["insert"] == 2000
    with pytest.raises(Exception, match="a key stands on"):
        table.mirror(source.union(source.filter("id = 3")))
    with pytest.raises(Exception, match="key column id is null"):
        table.mirror(source.union(spark.createDataFrame([(None, 1, "a")], "id long, v long, t string")))
    assert table.current().count() == 2000


def test_a_batch_that_comes_again_is_left_out(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", ["id"], 4)
    take = lambda rows, number, **kw: take_batch(table, spark.createDataFrame(rows, SCHEMA), number, ["id"], "updated_at", **kw)
    assert take([(1, "a", DAY[0])], ("s", 0), policy="error") == 1
    assert take([(1, "a", DAY[0])], ("s", 0), policy="error") == 0
    assert take([(2, "b", DAY[0])], ("s", 1), policy="error") == 1
    assert take([(1, "z", DAY[5])], ("s", 0)) == 0
    assert take([], ("s", 2)) == 0
    assert take([(9, "z", DAY[5])], ("s", 2)) == 0  # the empty batch was noted
    with pytest.raises(ValueError, match="keys exist already"):
        take([(1, "a", DAY[0])], ("another", 0), policy="error", only_newer=False)
    assert sorted(r["id"] for r in table.current().collect()) == [1, 2]
    table.publish(table.current())
    assert take([(1, "z", DAY[5])], ("s", 1)) == 0


def test_a_stream_that_ends_after_the_commit(spark, tmp_path):
    """The batch's commit is there, the stream's note of it isn't: the stream delivers it again."""
    target, schema = VersionedTable(spark, f"{tmp_path}/t", ["id"], 2), spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame([(1, "a", DAY[0])], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    go = lambda: continuous_sync(spark, f"{tmp_path}/in", schema, target, f"{tmp_path}/cp", ["id"], "updated_at", policy="error", only_newer=False).awaitTermination()
    go()
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    go()
    assert target._numbers() == [0] and target.current().count() == 1


def test_marks_move_with_the_data(spark, tmp_path):
    target, marks = VersionedTable(spark, f"{tmp_path}/t", ["id"], 2), changes.Checkpoints(spark, f"{tmp_path}/c")
    rows = lambda n: spark.createDataFrame([(i, "a", DAY[i]) for i in range(n)], SCHEMA)
    go = lambda n: changes.incremental_sync(rows(n), target, ["id"], marks, "m")
    go(2)
    assert target.mark("m") == {"column": "updated_at", "kind": "ts", "hi": DAY[1].isoformat()}
    # Another sync of the mapping commits while this one is on its way: this one fails, and the mark stays where the other has set it.
    slow = VersionedTable(spark, f"{tmp_path}/t", ["id"], 2)
    commit = slow._commit
    slow._commit = lambda *a: (go(5), commit(*a))
    with pytest.raises(Conflict):
        changes.incremental_sync(rows(3), slow, ["id"], marks, "m")
    assert target.mark("m")["hi"] == DAY[4].isoformat() and marks.get("m")["hi_ts"] == DAY[4]
    assert target.current().count() == 5
    # Lost checkpoints don't matter, as the commit has the mark.
    again = changes.incremental_sync(rows(7), target, ["id"], changes.Checkpoints(spark, f"{tmp_path}/other"), "m")
    assert (again.mode, again.n_rows) == ("incremental", 2)


def test_checkpoints_never_move_back_and_stay_small(spark, tmp_path):
    marks = changes.Checkpoints(spark, f"{tmp_path}/c")
    for hi in (3, 9, 5, 12, 1):
        marks.put("m", "id", "id", hi)
        marks.put("other", "at", "ts", DAY[hi % 7])
    assert marks.get("m")["hi_id"] == 12 and marks.get("none") is None
    assert len(list((tmp_path / "c").rglob("*.json"))) == 4
    marks.put("m", "id", "id", 4, back=True)
    assert sorted((r["mapping_id"], r["hi_id"], r["hi_ts"]) for r in marks.all().collect()) == [("m", 4, None), ("other", None, DAY[5])]
    # Two that write at once: the second sees the first's mark and begins again.
    last, seen = marks._last, []

    def meanwhile(mapping):
        found = last(mapping)
        if not seen:
            seen.append(1)
            changes.Checkpoints(spark, f"{tmp_path}/c").put("m", "id", "id", 20)
        return found

    marks._last = meanwhile
    marks.put("m", "id", "id", 15)
    assert last("m")[1]["hi_id"] == 20


PLAN = "mapping_id string, source_table string, target_table string, sync_mode string, keys array<string>, where_clause string, enabled boolean, sort_order int, buckets int, layout string"


def plan_of(spark, n, buckets=0):
    return spark.createDataFrame([(f"m{i}", f"s{i}", f"t{i}", "full", ["id"], None, True, i, buckets, None) for i in range(n)], PLAN).withColumn("created_at", F.lit(DAY[0]))


def test_tables_run_at_once(spark, tmp_path):
    """Two tables wait for each other while they are read, so they must overlap; the report has the plan's order."""
    both = threading.Barrier(2, timeout=60)

    def read(name):
        both.wait()
        return spark.range(5)

    report = run.sync_tables(plan_of(spark, 4, 2), read, str(tmp_path), "r", at_once=2)
    assert [(r["mapping_id"], r["status"], r["n_rows"]) for r in report.collect()] == [(f"m{i}", "completed", 5) for i in range(4)]
    assert len(VersionedTable(spark, f"{tmp_path}/tables/t0")._last()[2]) == 2


def test_a_critical_error_cancels_the_others(spark, tmp_path):
    begun = threading.Event()

    def read(name):
        if name == "s0":  # a job that would take minutes
            begun.set()
            return spark.range(0, 10**12, 1, 4).filter("pmod(xxhash64(id), 1000000007) = 5")
        if name == "s1":
            begun.wait(60)
            time.sleep(1)
            raise PermissionError("Access denied for user")
        return spark.range(5)

    report = run.sync_tables(plan_of(spark, 4), read, str(tmp_path), "r", at_once=2)
    assert [(r["mapping_id"], r["status"]) for r in report.collect()] == [("m0", "cancelled"), ("m1", "failed")]
    again = run.sync_tables(plan_of(spark, 4), lambda name: spark.range(5), str(tmp_path), "r", at_once=2)
    assert sorted({r["mapping_id"] for r in again.filter("status = 'completed'").collect()}) == ["m0", "m1", "m2", "m3"]


def test_stream_keeps_later_rows(spark, tmp_path):
    target = VersionedTable(spark, f"{tmp_path}/t")

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        continuous_sync(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, target, f"{tmp_path}/cp", ["id"], "updated_at").awaitTermination()

    feed([(1, "a", DAY[3]), (1, "older", DAY[2]), (2, "b", DAY[0])])
    feed([(1, "late", DAY[1]), (2, "B", DAY[1])])
    assert sorted((r["id"], r["v"]) for r in target.current().collect()) == [(1, "a"), (2, "B")]


def test_syncs_into_a_database(spark, tmp_path):
    """As into files: full, then incremental by policy; the mark moves with the data or not at all."""
    from plyweave.operators.database import DatabaseTable

    url, schema = "jdbc:derby:memory:target;create=true", "ID int, N int, UPDATED_AT timestamp_ntz"
    marks = changes.Checkpoints(spark, f"{tmp_path}/c")
    rows = lambda *r: spark.createDataFrame([(i, n, DAY[d]) for i, n, d in r], schema)
    go = lambda df, **kw: changes.incremental_sync(df, DatabaseTable(spark, url, "T"), ["ID"], marks, "it's", **kw)
    read = lambda: sorted((r["ID"], r["N"]) for r in DatabaseTable(spark, url, "T").current().collect())
    hi = lambda: DatabaseTable(spark, url, "T").mark("it's")["hi"]
    assert DatabaseTable(spark, url, "T").current() is None and DatabaseTable(spark, url, "T").mark("it's") is None
    first = rows((1, 1, 0), (2, 2, 1))
    assert (go(first).mode, read(), hi()) == ("full", [(1, 1), (2, 2)], DAY[1].isoformat())
    assert go(first).n_rows == 0
    more = rows((1, 10, 2), (1, 9, 1), (2, 2, 1), (3, 3, 3))
    assert (go(more).n_rows, read(), hi()) == (2, [(1, 10), (2, 2), (3, 3)], DAY[3].isoformat())
    assert (go(rows((1, 99, 4), (4, 4, 4)), policy="skip").n_rows, read()) == (2, [(1, 10), (2, 2), (3, 3), (4, 4)])
    with pytest.raises(ValueError, match="keys exist already"):
        go(rows((1, 5, 5), (5, 5, 5)), policy="error")
    assert (len(read()), hi()) == (4, DAY[4].isoformat())
    # Another sync moves the mark while this one is on its way.
    slow, other = DatabaseTable(spark, url, "T"), rows((6, 6, 6))
    change = slow._change
    slow._change = lambda *a, **kw: (go(other), change(*a, **kw))
    with pytest.raises(Conflict):
        changes.incremental_sync(rows((7, 7, 5)), slow, ["ID"], marks, "it's")
    assert (read()[-1], hi()) == ((6, 6), DAY[6].isoformat())
