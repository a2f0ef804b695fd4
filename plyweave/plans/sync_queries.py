"""Registered queries on pulls, merges, comparisons, profiles and checks of tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyweave.functions.clean import strip_supplementary
from plyweave.operators import changes, compare, merge, profile, quality
from plyweave.operators.database import DatabaseTable
from plyweave.plans import run
from plyweave.plans.fixtures import mappings, source_orders, table, target_orders, with_tables
from plyweave.sources import tables
from plyweave.sources.versioned import VersionedTable
from plyweave.streaming.continuous import continuous_sync, take_batch

KEYS = ["o_orderkey"]
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, which only a session in one process may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-plyweave-")
    return f"{base.rstrip('/')}/plyweave-{uuid.uuid4().hex}"


def delta_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = source_orders(spark, sf_dir)
    hi = changes.high_water_mark(source, "updated_at").first()["hi"]
    return changes.pull_changes(source, "updated_at", F.lit("1999-01-01").cast("timestamp_ntz"), F.lit(hi))


def full_copy_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = VersionedTable(spark, work_dir(spark))
    target.publish(tables.read_table(spark, f"{sf_dir}/orders.parquet", "o_orderstatus IN ('F', 'O') AND o_totalprice > 100000", file_format="parquet"))
    return target.current()


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_count(table(spark, sf_dir, "orders"), "o_orderstatus IN ('F', 'O') AND o_totalprice > 100000")


def preview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.preview(table(spark, sf_dir, "events"), ["event_id"], 250, 100)


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda df, c: df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return profile.table_stats({"orders": (day(target_orders(spark, sf_dir), "updated_at"), "updated_at"), "events": (day(table(spark, sf_dir, "events"), "ts"), "ts"), "customer": (table(spark, sf_dir, "customer"), None)})


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(target_orders(spark, sf_dir), exact=True)


def pull_by_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = source_orders(spark, sf_dir)
    column, _ = changes.tracking_column(source.schema)
    hi = changes.high_water_mark(source, column).first()["hi"]
    return changes.pull_changes(source, column, F.lit("1999-01-01").cast("timestamp_ntz"), F.lit(hi), "o_orderstatus <> 'P' OR o_totalprice > 200000")


def pull_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    hi = changes.high_water_mark(source, "event_id").first()["hi"]
    return changes.pull_changes(source, "event_id", F.lit(changes.parse_id_mark("5000")), F.lit(hi), "event_type <> 'view'")


def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.high_water_marks({"orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "events": (table(spark, sf_dir, "events"), "event_id"), "part": (table(spark, sf_dir, "part"), "p_partkey")})


def sync_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([("orders", 4000), ("events", 5000), ("part", None)], "mapping_id string, hi_id long")
    return changes.sync_lag({"orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "events": (table(spark, sf_dir, "events"), "event_id"), "part": (table(spark, sf_dir, "part"), "p_partkey")}, marks)


def sync_lag_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.sql("SELECT 'orders' AS mapping_id, TIMESTAMP_NTZ '1999-01-01' AS hi_ts UNION ALL SELECT 'events', TIMESTAMP_NTZ '2030-01-01' UNION ALL SELECT 'lines', NULL")
    found = {"orders": (source_orders(spark, sf_dir), "updated_at"), "events": (table(spark, sf_dir, "events"), "ts"), "lines": (table(spark, sf_dir, "lineitem"), "l_shipdate")}
    return changes.sync_lag(found, marks, "ts")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _upper(orders: DataFrame) -> DataFrame:
    """The columns as the database names them."""
    return orders.select(*[F.col(c).alias(c.upper()) for c in ORDER_COLUMNS])


def _lower(orders: DataFrame) -> DataFrame:
    return orders.toDF(*[c.lower() for c in orders.columns])


def _database(spark: SparkSession, orders: DataFrame, **options: str) -> str:
    """The url of a new database in memory that has the given orders."""
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    merge.append_jdbc(_upper(orders), url, "orders", **options)
    return url


def jdbc_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _database(spark, table(spark, sf_dir, "orders"))
    return _lower(tables.read_jdbc(spark, url, "orders", "O_ORDERKEY", "o_totalprice > 100000", partitions=4))


def jdbc_replace_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drifted target whose content is replaced by the source's."""
    url = _database(spark, target_orders(spark, sf_dir))
    merge.replace_content(spark, _upper(source_orders(spark, sf_dir)), url, "orders")
    return _lower(tables.read_jdbc(spark, url, "orders", "O_ORDERKEY", partitions=4))


def jdbc_failed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of which one task of four fails, after others have sent their rows: the drifted target stays as it was."""
    url, k = _database(spark, target_orders(spark, sf_dir)), F.col("o_orderkey")
    broken = source_orders(spark, sf_dir).repartitionById(4, (k % 4).cast("int"))
    broken = broken.withColumn("o_totalprice", F.when(k % 4 == 2, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("o_totalprice")))
    try:
        merge.replace_content(spark, _upper(broken), url, "orders")
    except Exception as error:  # noqa: BLE001  what the driver raises differs
        if "boom" not in str(error):
            raise
    return _lower(tables.read_jdbc(spark, url, "orders", "O_ORDERKEY", partitions=4))


def jdbc_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table most of whose keys are in a hundredth of their span, some null, by a key of text and numbers."""
    k = F.col("o_orderkey")
    skewed = table(spark, sf_dir, "orders").withColumns({"o_orderkey": F.when(k % 10 == 3, k * 1000).otherwise(k), "o_orderstatus": F.when(k % 10 != 7, "it's").otherwise("P"), "o_custkey": F.when(k % 10 != 7, F.col("o_custkey"))})
    return _lower(tables.read_jdbc(spark, _database(spark, skewed, createTableColumnTypes="O_ORDERSTATUS VARCHAR(20)"), "orders", ["O_ORDERSTATUS", "O_ORDERKEY", "O_CUSTKEY"], "o_totalprice > 100000", partitions=8))


def jdbc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _database(spark, target_orders(spark, sf_dir))
    merge.upsert_jdbc(spark, _upper(delta_orders(spark, sf_dir)), url, "orders", ["O_ORDERKEY"])
    return _lower(tables.read_jdbc(spark, url, "orders", "O_ORDERKEY", partitions=4))


def mirror_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 64 ranges made equal to its source, from which it differs among the smallest keys and beyond the largest: by changes, deletes and inserts."""
    return _mirrored(spark, sf_dir)[0].current()


def mirror_bucket_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(_mirrored(spark, sf_dir)[1].items()), "action string, n_rows long")


def _mirrored(spark: SparkSession, sf_dir: str) -> tuple[VersionedTable, dict[str, int]]:
    source, k = source_orders(spark, sf_dir), F.col("o_orderkey")
    target = VersionedTable(spark, f"{work_dir(spark)}/orders", KEYS, 64, "range")
    stale = source.withColumn("o_totalprice", F.when((k % 15 == 1) & (k < 1000), F.col("o_totalprice") + 0.001).otherwise(F.col("o_totalprice")))
    target.publish(stale.filter("NOT (o_orderkey % 15 = 2 AND o_orderkey < 1000)").unionByName(source.filter("o_orderkey % 15 = 3 AND o_orderkey < 1000").withColumn("o_orderkey", k + 10_000_000)))
    return target, target.mirror(source)


def range_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of growing events into a table of 16 ranges of their id, the newest of which are cut as they grow."""
    root, events = work_dir(spark), table(spark, sf_dir, "events")
    target, marks = VersionedTable(spark, f"{root}/events", ["event_id"], 16, "range"), changes.Checkpoints(spark, f"{root}/checkpoints")
    most = events.agg(F.max("event_id")).first()[0]
    for share in (0.4, 0.6, 1.0):
        changes.incremental_sync(events.filter(F.col("event_id") <= int(most * share)), target, ["event_id"], marks, "events", id_column="event_id", versions=False)
    return target.current()


def marks_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last commits of two synced tables have as marks, and the checkpoints have too."""
    root = work_dir(spark)
    marks, rows = changes.Checkpoints(spark, f"{root}/checkpoints"), []
    for name, df, keys, id_column in (("orders", source_orders(spark, sf_dir), KEYS, None), ("events", table(spark, sf_dir, "events"), ["event_id"], "event_id")):
        target = VersionedTable(spark, f"{root}/{name}", keys, 4)
        for part in (df.filter(F.col(keys[0]) % 3 == 0), df):
            changes.incremental_sync(part, target, keys, marks, name, id_column=id_column)
        mark = target.mark(name)
        rows.append((name, mark["column"], mark["kind"], str(mark["hi"]).replace("T", " "), target.current().count()))
    kept = marks.all().select(F.col("mapping_id").alias("table"), F.coalesce(F.col("hi_id").cast("string"), F.col("hi_ts").cast("string")).alias("hi_kept"))
    return spark.createDataFrame(rows, "table string, column string, kind string, hi string, n_rows long").join(kept, "table")


def jdbc_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drifted table in a database made equal to its source, deletes included."""
    url = _database(spark, target_orders(spark, sf_dir))
    merge.mirror_jdbc(spark, _upper(source_orders(spark, sf_dir)), url, "orders", ["O_ORDERKEY"])
    return _lower(tables.read_jdbc(spark, url, "orders", "O_ORDERKEY", partitions=4))


EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]


def database_to_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of two mappings from one database to another, events by their id and orders whole, run twice while the source grows."""
    text = {"createTableColumnTypes": "EVENT_TYPE VARCHAR(20)"}
    events = table(spark, sf_dir, "events").select(*[F.col(c).alias(c.upper()) for c in EVENT_COLUMNS])
    url, there, root = _database(spark, table(spark, sf_dir, "orders")), f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", work_dir(spark)
    plan = spark.createDataFrame([("m1", "events", "events_copy", "incremental", ["EVENT_ID"], "EVENT_TYPE <> 'view'", True, 1), ("m2", "orders", "orders_copy", "full", ["O_ORDERKEY"], "O_TOTALPRICE > 100000", True, 2)], "mapping_id string, source_table string, target_table string, sync_mode string, keys array<string>, where_clause string, enabled boolean, sort_order int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    most = events.agg(F.max("EVENT_ID")).first()[0] * 6 // 10
    keys = {"events": "EVENT_ID", "orders": "O_ORDERKEY"}
    for number, part in enumerate((events.filter(F.col("EVENT_ID") <= most), events.filter(F.col("EVENT_ID") > most))):
        merge.append_jdbc(part, url, "events", **text)
        target = lambda m: DatabaseTable(spark, there, m["target_table"], **(text if m["mapping_id"] == "m1" else {}))
        run.sync_tables(plan, lambda name: tables.read_jdbc(spark, url, name, keys[name], partitions=4), root, f"r{number}", id_columns={"m1": "EVENT_ID"}, target=target).collect()
    found = tables.read_jdbc(spark, there, "events_copy", "EVENT_ID", partitions=4).select(F.lit("events").alias("table"), F.col("EVENT_ID").alias("key"), F.col("VALUE").alias("number"))
    return found.unionByName(tables.read_jdbc(spark, there, "orders_copy", "O_ORDERKEY", partitions=4).select(F.lit("orders").alias("table"), F.col("O_ORDERKEY").alias("key"), F.col("O_TOTALPRICE").alias("number")))


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/orders"
    for rows in (target_orders(spark, sf_dir), delta_orders(spark, sf_dir)):
        merge.append(rows, path)
    return spark.read.parquet(path)


def partition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target by buckets of its key, a delta that touches few of them."""
    path, bucket = f"{work_dir(spark)}/orders", F.pmod(F.col("o_orderkey"), F.lit(16)).alias("part")
    target_orders(spark, sf_dir).select("*", bucket).write.partitionBy("part").parquet(path)
    delta = delta_orders(spark, sf_dir).select("*", bucket).filter("part IN (3, 5)")
    merge.upsert_partitions(spark, path, delta, KEYS, ["part"])
    return spark.read.schema(delta.schema).parquet(path)


def bucketed_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As incremental_sync, into a table of 16 buckets, of versions of lines: the latest of each order and part by ship date."""
    root, lines = work_dir(spark), table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "updated_at")
    target, marks = VersionedTable(spark, f"{root}/lines", ["l_orderkey"], 16), changes.Checkpoints(spark, f"{root}/checkpoints")
    for rows in (lines.filter(F.col("updated_at") <= F.lit("1999-01-01").cast("timestamp_ntz")), lines):
        changes.incremental_sync(rows, target, ["l_orderkey"], marks, "lines", tiebreak=["l_linenumber", "l_partkey", "l_suppkey"])
    target.vacuum(1)
    return target.current()


def copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy by four tasks that succeeds, and one of which a task fails, by their counts and by the rows that this task has not written."""
    path, key = work_dir(spark), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").repartitionById(4, (key % 4).cast("int"))
    broken = F.when(key % 4 == 2, F.raise_error(F.lit("boom")).cast("long")).otherwise(key)
    writes = {"copied": lambda df: df.write.parquet(f"{path}/copy"), "broken": lambda df: df.withColumn("o_custkey", broken).write.parquet(f"{path}/broken")}
    rows = []
    for name, write in writes.items():
        seen = run.copy_metrics(orders, write, "o_totalprice > 100000", "o_orderkey")
        lost = [t for t in seen["tasks"] if t["status"] == "FAILED"]
        whole = [seen[c] for c in ("processed_rows", "failed_rows", "batches")] if not lost else [None] * 3
        rows.append((name, seen["total_rows"], seen["filtered_rows"], *whole, seen["error"] is not None, *([lost[0][c] for c in ("task", "failed_rows", "first_key", "last_key")] if lost else [None] * 4)))
    return spark.createDataFrame(rows, "copy string, total_rows long, filtered_rows long, processed_rows long, failed_rows long, batches long, has_error boolean, task long, task_rows long, first_key long, last_key long")


def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(target_orders(spark, sf_dir), delta_orders(spark, sf_dir), KEYS)


def upsert_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(target_orders(spark, sf_dir), delta_orders(spark, sf_dir), KEYS, merge.SKIP)


def upsert_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.collisions(target_orders(spark, sf_dir), delta_orders(spark, sf_dir), KEYS)


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ["event_id"])


def mirror_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.mirror_merge(source_orders(spark, sf_dir), target_orders(spark, sf_dir), KEYS)


def mirror_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.mirror_actions(source_orders(spark, sf_dir), target_orders(spark, sf_dir), KEYS)


def strip_4_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\U0001f600"))).when(F.col("doc_id") % 7 == 1, None).otherwise(F.concat(F.lit("￿"), F.col("text")))
    return strip_supplementary(table(spark, sf_dir, "documents").select("doc_id", odd.alias("text")))


def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.validate_counts(source_orders(spark, sf_dir), target_orders(spark, sf_dir), "o_orderkey % 5 <> 0")


def row_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.row_checksums(target_orders(spark, sf_dir), KEYS)


def checksum_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.checksum_mismatches(source_orders(spark, sf_dir), target_orders(spark, sf_dir), KEYS)


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.table_fingerprint(target_orders(spark, sf_dir), "o_orderkey", 1000)


def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir, 100)


def row_diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir, None)


def _differences(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    found = compare.row_diff(source_orders(spark, sf_dir), target_orders(spark, sf_dir), KEYS, most)
    return found.select("o_orderkey", F.concat_ws(",", "columns").alias("columns"), F.col("source_values")["o_orderstatus"].alias("source_status"), F.col("target_values")["o_orderstatus"].alias("target_status"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.reconcile(source_orders(spark, sf_dir), target_orders(spark, sf_dir), KEYS)


def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.reconcile_summary(source_orders(spark, sf_dir), target_orders(spark, sf_dir), KEYS)


def reconcile_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = source_orders(spark, sf_dir)
    late = source.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4001 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return compare.reconcile_by_ranges(source, late.filter(F.col("o_orderkey") % 3001 != 0), KEYS, "o_orderkey", 500)


def _small_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with fractions of seconds and customers that aren't known, and a copy that differs by half a second, a thousandth, or a customer."""
    k = F.col("o_orderkey")
    later = lambda unit: F.expr(f"INTERVAL '{unit}' SECOND")
    source = source_orders(spark, sf_dir).withColumns({"updated_at": F.col("updated_at") + later("0.25"), "o_custkey": F.when(k % 10 != 0, F.col("o_custkey"))})
    target = source.withColumns({
        "updated_at": F.when(k % 997 == 1, F.col("updated_at") + later("0.5")).otherwise(F.col("updated_at")),
        "o_totalprice": F.when(k % 991 == 2, F.col("o_totalprice") + 0.001).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(k % 1010 == 0, None).otherwise(F.col("o_orderstatus")),
    })
    return source, target


def reconcile_small_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ranges of a column that may be null."""
    return compare.reconcile_by_ranges(*_small_changes(spark, sf_dir), KEYS, "o_custkey", 10, levels=3, fanout=10)


def reconcile_by_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hashes of a key of four columns, one of them text."""
    lines = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    shifted = lines.withColumn("l_tax", F.when(F.col("l_orderkey") % 1009 == 5, F.col("l_tax") + 1e-9).otherwise(F.col("l_tax")))
    return compare.reconcile_by_ranges(lines, shifted.filter("l_orderkey % 2003 <> 7"), LINE_KEYS)


def checksums_of_small_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.checksum_mismatches(*_small_changes(spark, sf_dir), KEYS)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return quality.orphans(mappings(spark, sf_dir), nation, "sync_config_id", "id").select("id", "sync_config_id")


def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.when(F.col("l_orderkey") % 97 == 0, None).otherwise(F.col("l_linenumber")))
    return quality.key_violations(lines, ["l_orderkey", "l_linenumber"])


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mappings(spark, sf_dir).withColumn("target_table", F.when(F.col("id") % 50 == 0, F.lit(" ")).when(F.col("id") % 3 == 0, F.regexp_replace("target_table", "#", "_")).otherwise(F.col("target_table")))
    rules = {
        "target_table is required": quality.required("target_table"),
        "sync_mode is unknown": quality.one_of("sync_mode", ["full"]),
        "source and target are the same": quality.must_differ("source_table", "target_table"),
        "target_table is no identifier": quality.identifier("target_table"),
        "sort_order is out of range": quality.in_range("sort_order", 5, 45),
    }
    return quality.rule_violations(rows, ["id"], rules)


def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.chunk_metrics(table(spark, sf_dir, "lineitem"), "l_orderkey", 1000)


def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds: a full one over what there was by 1999, then the changes since."""
    root, source = work_dir(spark), source_orders(spark, sf_dir)
    target, marks = VersionedTable(spark, f"{root}/orders", KEYS, 8), changes.Checkpoints(spark, f"{root}/checkpoints")
    early = source.filter(F.col("updated_at") <= F.lit("1999-01-01").cast("timestamp_ntz"))
    early = early.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    for rows in (early, source):
        changes.incremental_sync(rows, target, KEYS, marks, "orders", "o_orderstatus <> 'P'")
    return target.current()


def sync_tables_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four mappings, one of them broken, one off; the second call with the same run finds nothing left but the broken one."""
    root = work_dir(spark)
    rows = [("m1", "nation", "nation_copy", "full", ["n_nationkey"], None, True, 2), ("m2", "nowhere", "lost", "full", ["x"], None, True, 1), ("m3", "orders", "orders_copy", "incremental", KEYS, "o_totalprice > 100000", True, 3), ("m4", "part", "part_copy", "full", ["p_partkey"], None, False, 4)]
    plan = spark.createDataFrame(rows, "mapping_id string, source_table string, target_table string, sync_mode string, keys array<string>, where_clause string, enabled boolean, sort_order int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    for _ in range(2):
        report = run.sync_tables(plan, lambda name: table(spark, sf_dir, name), root, "r1", id_columns={"m3": "o_orderkey"})
    return report.groupBy("mapping_id", "status", "mode").agg(F.count(F.lit(1)).alias("n_runs"), F.max("n_rows").alias("n_rows"))


def sync_tables_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six mappings, three at a time, their keys, buckets and ranges from the plan; two rounds over growing tables; what each has in the end."""
    root, stamp = work_dir(spark), F.lit("2024-01-01").cast("timestamp_ntz")
    kinds = [("orders", "incremental", ["o_orderkey"], 8, "hash"), ("events", "incremental", ["event_id"], 8, "range"), ("part", "full", ["p_partkey"], 4, "hash"), ("customer", "full", ["c_custkey"], 0, None), ("nowhere", "full", ["x"], 2, "hash"), ("supplier", "full", ["s_suppkey"], 3, "range")]
    plan = spark.createDataFrame([(f"m{i}", k[0], f"{k[0]}_copy", k[1], k[2], None, True, i, k[3], k[4]) for i, k in enumerate(kinds)], "mapping_id string, source_table string, target_table string, sync_mode string, keys array<string>, where_clause string, enabled boolean, sort_order int, buckets int, layout string").withColumn("created_at", stamp)
    ids = {"m0": "o_orderkey", "m1": "event_id"}
    for r in ("r1", "r2"):
        read = lambda name, r=r: table(spark, sf_dir, name).filter("o_orderkey % 4 <> 0" if r == "r1" and name == "orders" else "true")
        report = run.sync_tables(plan, read, root, r, id_columns=ids, at_once=3)
    sizes = [(f"m{i}", VersionedTable(spark, f"{root}/tables/{k[0]}_copy").current().count()) for i, k in enumerate(kinds) if k[0] != "nowhere"]
    found = report.select("position", "mapping_id", "status", "mode", "n_rows")
    return found.join(spark.createDataFrame(sizes, "mapping_id string, in_target long"), "mapping_id", "left")


def replayed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four batches of a stream, each delivered twice, as after a crash, under the policy that refuses keys that exist."""
    events, target = table(spark, sf_dir, "events"), VersionedTable(spark, f"{work_dir(spark)}/events", ["event_id"], 4)
    for number in (0, 1, 1, 0, 2, 3, 3):
        take_batch(target, events.filter(F.col("event_id") % 4 == number), ("stream", number), ["event_id"], "ts", policy="error", only_newer=False)
    versions = target.commits().select("version").distinct().count()
    return target.current().groupBy((F.col("event_id") % 4).alias("batch")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_versions", F.lit(versions).cast("long"))


def continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, merged by user and type: the latest of each stays."""
    root, events = work_dir(spark), table(spark, sf_dir, "events")
    events.repartition(4, "event_id").write.parquet(f"{root}/in")
    target = VersionedTable(spark, f"{root}/latest", ["user_id", "event_type"], 8)
    query = continuous_sync(spark, f"{root}/in", events.schema, target, f"{root}/checkpoint", ["user_id", "event_type"], "ts", ["event_id"], files_per_batch=2)
    query.awaitTermination()
    return target.current()


_DRIFT = ["src_orders", "tgt_orders"]
_PAIR = [*_DRIFT, "delta_orders"]
_SAME = "s.o_custkey IS NOT DISTINCT FROM t.o_custkey AND s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus AND s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AND s.updated_at IS NOT DISTINCT FROM t.updated_at AND s.o_orderpriority IS NOT DISTINCT FROM t.o_orderpriority"
_STATUS = f"SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'only_source' WHEN s.o_orderkey IS NULL THEN 'only_target' WHEN {_SAME} THEN 'same' ELSE 'changed' END AS status FROM src_orders s FULL JOIN tgt_orders t ON s.o_orderkey = t.o_orderkey"
_TEXTS = ["o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "o_totalprice::VARCHAR", "updated_at::VARCHAR", "o_orderpriority"]
_MD5 = "md5(" + " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in _TEXTS) + ")"


def _profile_sql() -> str:
    columns = [("o_orderkey", "bigint", False), ("o_custkey", "bigint", False), ("o_orderstatus", "string", True), ("o_totalprice", "double", False), ("updated_at", "timestamp_ntz", False), ("o_orderpriority", "string", True)]
    one = lambda i, c, kind, text: f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) - count({c}) AS n_nulls, {f'max(length({c}))' if text else 'NULL::BIGINT'} AS max_length, count(DISTINCT {c}) AS n_distinct FROM tgt_orders"
    return " UNION ALL ".join(one(i + 1, *c) for i, c in enumerate(columns))


ENTRIES = {
    "full_copy_filtered": (full_copy_filtered, "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000"),
    "row_count": (row_count, "SELECT count(*) AS n_rows FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000"),
    "preview_page": (preview_page, "SELECT * FROM events ORDER BY event_id LIMIT 100 OFFSET 250"),
    "table_stats": (table_stats, with_tables(_DRIFT, """
        SELECT 'orders' AS "table", count(*) AS n_rows, CAST(count(*) - count(o_orderstatus) AS BIGINT) AS n_null_cells, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_value FROM tgt_orders
        UNION ALL SELECT 'events', count(*), 0, strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events
        UNION ALL SELECT 'customer', count(*), 0, NULL FROM customer""")),
    "column_profile": (column_profile, with_tables(_DRIFT, _profile_sql())),
    "pull_by_timestamp": (pull_by_timestamp, with_tables(["delta_orders"], "SELECT * FROM delta_orders WHERE (o_orderstatus <> 'P' OR o_totalprice > 200000)")),
    "pull_by_id": (pull_by_id, "SELECT * FROM events WHERE event_id > 5000 AND event_id <= (SELECT max(event_id) FROM events) AND event_type <> 'view'"),
    "high_water_marks": (high_water_marks, """
        SELECT 'orders' AS "table", 'o_orderkey' AS "column", max(o_orderkey)::VARCHAR AS hi, count(*) AS n_rows FROM orders
        UNION ALL SELECT 'events', 'event_id', max(event_id)::VARCHAR, count(*) FROM events UNION ALL SELECT 'part', 'p_partkey', max(p_partkey)::VARCHAR, count(*) FROM part"""),
    "sync_lag": (sync_lag, """
        SELECT 'orders' AS "table", max(o_orderkey) AS hi_source, 4000::BIGINT AS hi_mark, count(*) FILTER (o_orderkey > 4000) AS n_behind FROM orders
        UNION ALL SELECT 'events', max(event_id), 5000, count(*) FILTER (event_id > 5000) FROM events UNION ALL SELECT 'part', max(p_partkey), NULL, count(*) FILTER (p_partkey > 0) FROM part"""),
    "sync_lag_by_time": (sync_lag_by_time, """
        SELECT 'orders' AS "table", max(o_orderdate) AS hi_source, TIMESTAMP '1999-01-01' AS hi_mark, count(*) FILTER (o_orderdate > TIMESTAMP '1999-01-01') AS n_behind FROM orders
        UNION ALL SELECT 'events', max(ts), TIMESTAMP '2030-01-01', 0 FROM events UNION ALL SELECT 'lines', max(l_shipdate), NULL, count(l_shipdate) FROM lineitem"""),
    "jdbc_range_scan": (jdbc_range_scan, f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders WHERE o_totalprice > 100000"),
    "jdbc_replace_content": (jdbc_replace_content, f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders"),
    "jdbc_failed_replace": (jdbc_failed_replace, with_tables(_DRIFT, f"SELECT {', '.join(ORDER_COLUMNS)} FROM tgt_orders")),
    "jdbc_split_scan": (jdbc_split_scan, "SELECT CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey * 1000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 10 <> 7 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 10 <> 7 THEN 'it''s' ELSE 'P' END AS o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000"),
    "jdbc_upsert": (jdbc_upsert, with_tables(_PAIR, f"SELECT {', '.join(ORDER_COLUMNS)} FROM delta_orders UNION ALL SELECT {', '.join(ORDER_COLUMNS)} FROM tgt_orders t WHERE NOT EXISTS (SELECT 1 FROM delta_orders d WHERE d.o_orderkey = t.o_orderkey)")),
    "jdbc_mirror": (jdbc_mirror, f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders"),
    "database_to_database": (database_to_database, """
        SELECT 'events' AS "table", event_id AS key, value AS number FROM events WHERE event_type <> 'view' UNION ALL SELECT 'orders', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000"""),
    "append_rows": (append_rows, with_tables(_PAIR, "SELECT * FROM tgt_orders UNION ALL SELECT * FROM delta_orders")),
    "partition_upsert": (partition_upsert, with_tables(_PAIR, """
        SELECT *, o_orderkey % 16 AS part FROM (
          SELECT * FROM delta_orders WHERE o_orderkey % 16 IN (3, 5)
          UNION ALL SELECT * FROM tgt_orders t WHERE NOT EXISTS (SELECT 1 FROM delta_orders d WHERE d.o_orderkey = t.o_orderkey AND d.o_orderkey % 16 IN (3, 5)))""")),
    "bucketed_sync": (bucketed_sync, """
        SELECT * RENAME (l_shipdate AS updated_at) FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1"""),
    "mirror_buckets": (mirror_buckets, with_tables(["src_orders"], "SELECT * FROM src_orders")),
    "mirror_bucket_actions": (mirror_bucket_actions, """
        SELECT * FROM (
          SELECT CASE WHEN o_orderkey >= 1000 THEN 'keep' WHEN o_orderkey % 15 = 1 THEN 'update' WHEN o_orderkey % 15 = 2 THEN 'insert' ELSE 'keep' END AS action, count(*) AS n_rows FROM orders GROUP BY 1
          UNION ALL SELECT 'delete', count(*) FROM orders WHERE o_orderkey % 15 = 3 AND o_orderkey < 1000) WHERE n_rows > 0"""),
    "range_sync": (range_sync, "SELECT * FROM events"),
    "marks_with_data": (marks_with_data, """
        SELECT 'orders' AS "table", 'updated_at' AS "column", 'ts' AS kind, max(o_orderdate)::VARCHAR AS hi, count(*) FILTER (o_orderkey % 3 = 0 OR o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 3 = 0)) AS n_rows, max(o_orderdate)::VARCHAR AS hi_kept FROM orders
        UNION ALL SELECT 'events', 'event_id', 'id', max(event_id)::VARCHAR, count(*) FILTER (event_id % 3 = 0 OR event_id > (SELECT max(event_id) FROM events WHERE event_id % 3 = 0)), max(event_id)::VARCHAR FROM events"""),
    "copy_counts": (copy_counts, """
        SELECT 'copied' AS copy, count(*) AS total_rows, count(*) FILTER (o_totalprice <= 100000) AS filtered_rows, count(*) FILTER (o_totalprice > 100000) AS processed_rows, 0::BIGINT AS failed_rows,
               4::BIGINT AS batches, false AS has_error, NULL::BIGINT AS task, NULL::BIGINT AS task_rows, NULL::BIGINT AS first_key, NULL::BIGINT AS last_key FROM orders
        UNION ALL SELECT 'broken', count(*), count(*) FILTER (o_totalprice <= 100000), NULL, NULL, NULL, true, 2, count(*) FILTER (o_totalprice > 100000 AND o_orderkey % 4 = 2),
               min(o_orderkey) FILTER (o_totalprice > 100000 AND o_orderkey % 4 = 2), max(o_orderkey) FILTER (o_totalprice > 100000 AND o_orderkey % 4 = 2) FROM orders"""),
    "upsert_overwrite": (upsert_overwrite, with_tables(_PAIR, "SELECT * FROM delta_orders UNION ALL SELECT * FROM tgt_orders t WHERE NOT EXISTS (SELECT 1 FROM delta_orders d WHERE d.o_orderkey = t.o_orderkey)")),
    "upsert_skip": (upsert_skip, with_tables(_PAIR, "SELECT * FROM tgt_orders UNION ALL SELECT * FROM delta_orders d WHERE NOT EXISTS (SELECT 1 FROM tgt_orders t WHERE d.o_orderkey = t.o_orderkey)")),
    "upsert_collisions": (upsert_collisions, with_tables(_PAIR, "SELECT o_orderkey FROM delta_orders WHERE o_orderkey IN (SELECT o_orderkey FROM tgt_orders)")),
    "latest_per_key": (latest_per_key, "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "mirror_merge": (mirror_merge, with_tables(["src_orders"], "SELECT * FROM src_orders")),
    "mirror_actions": (mirror_actions, with_tables(_DRIFT, f"SELECT CASE status WHEN 'only_source' THEN 'insert' WHEN 'only_target' THEN 'delete' WHEN 'changed' THEN 'update' ELSE 'keep' END AS action, count(*) AS n_rows FROM ({_STATUS}) GROUP BY 1")),
    "strip_supplementary": (strip_4_byte, r"SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN text || chr(128512) WHEN doc_id % 7 = 1 THEN NULL ELSE chr(65535) || text END, '[\x{10000}-\x{10FFFF}]', '', 'g') AS text FROM documents"),
    "validate_counts": (validate_counts, with_tables(_DRIFT, "SELECT a AS source_rows, b AS target_rows, a = b AS is_match FROM (SELECT (SELECT count(*) FROM src_orders WHERE o_orderkey % 5 <> 0) AS a, (SELECT count(*) FROM tgt_orders) AS b)")),
    "row_checksums": (row_checksums, with_tables(_DRIFT, f"SELECT o_orderkey, {_MD5} AS checksum FROM tgt_orders")),
    "checksum_mismatches": (checksum_mismatches, with_tables(_DRIFT, f"""
        SELECT count(*) FILTER (a <> b) AS n_changed, count(*) FILTER (b IS NULL) AS n_only_source, count(*) FILTER (a IS NULL) AS n_only_target
        FROM (SELECT o_orderkey, {_MD5} AS a FROM src_orders) FULL JOIN (SELECT o_orderkey, {_MD5} AS b FROM tgt_orders) USING (o_orderkey)""")),
    "table_fingerprint": (table_fingerprint, with_tables(_DRIFT, f"SELECT o_orderkey // 1000 AS chunk, count(*) AS n_rows, sum(('0x' || substr({_MD5}, 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM tgt_orders GROUP BY 1")),
    "row_diff": (row_diff, with_tables(_DRIFT, f"""
        SELECT s.o_orderkey, concat_ws(',', CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'o_totalprice' END) AS columns,
               CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN s.o_orderstatus END AS source_status, CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN t.o_orderstatus END AS target_status
        FROM src_orders s JOIN tgt_orders t ON s.o_orderkey = t.o_orderkey WHERE NOT ({_SAME}) ORDER BY 1 LIMIT 100""")),
    "row_diff_all": (row_diff_all, with_tables(_DRIFT, f"""
        SELECT s.o_orderkey, concat_ws(',', CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'o_totalprice' END) AS columns,
               CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN s.o_orderstatus END AS source_status, CASE WHEN s.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN t.o_orderstatus END AS target_status
        FROM src_orders s JOIN tgt_orders t ON s.o_orderkey = t.o_orderkey WHERE NOT ({_SAME})""")),
    "reconcile": (reconcile, with_tables(_DRIFT, _STATUS)),
    "reconcile_summary": (reconcile_summary, with_tables(_DRIFT, f"SELECT status, count(*) AS n_keys FROM ({_STATUS}) GROUP BY 1")),
    "reconcile_by_ranges": (reconcile_by_ranges, "SELECT o_orderkey, CASE WHEN o_orderkey % 3001 = 0 THEN 'only_source' ELSE 'changed' END AS status FROM orders WHERE o_orderkey % 3001 = 0 OR o_orderkey % 4001 = 0"),
    "reconcile_small_changes": (reconcile_small_changes, "SELECT o_orderkey, 'changed' AS status FROM orders WHERE o_orderkey % 997 = 1 OR o_orderkey % 991 = 2 OR o_orderkey % 1010 = 0 AND o_orderstatus IS NOT NULL"),
    "reconcile_by_hashes": (reconcile_by_hashes, """
        SELECT l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 2003 = 7 THEN 'only_source' ELSE 'changed' END AS status
        FROM lineitem WHERE l_orderkey % 2003 = 7 OR l_orderkey % 1009 = 5"""),
    "checksums_of_small_changes": (checksums_of_small_changes, """
        SELECT count(*) FILTER (o_orderkey % 997 = 1 OR o_orderkey % 991 = 2 OR o_orderkey % 1010 = 0 AND o_orderstatus IS NOT NULL) AS n_changed, 0::BIGINT AS n_only_source, 0::BIGINT AS n_only_target FROM orders"""),
    "duplicate_keys": (duplicate_keys, "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "orphans": (orphans, with_tables(["mappings"], "SELECT id, sync_config_id FROM mappings WHERE sync_config_id NOT IN (SELECT n_nationkey FROM nation)")),
    "key_violations": (key_violations, """
        SELECT * FROM (SELECT l_orderkey, n AS l_linenumber, count(*) AS n_rows, CASE WHEN n IS NULL THEN 'null key' WHEN count(*) > 1 THEN 'duplicate key' END AS problem
        FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_linenumber END AS n FROM lineitem) GROUP BY l_orderkey, n) WHERE problem IS NOT NULL"""),
    "rule_violations": (rule_violations, with_tables(["mappings"], """
        , m AS (SELECT * REPLACE (CASE WHEN id % 50 = 0 THEN ' ' WHEN id % 3 = 0 THEN replace(target_table, '#', '_') ELSE target_table END AS target_table) FROM mappings)
        SELECT id, 'target_table is required' AS rule FROM m WHERE trim(target_table) = ''
        UNION ALL SELECT id, 'sync_mode is unknown' FROM m WHERE sync_mode NOT IN ('full')
        UNION ALL SELECT id, 'source and target are the same' FROM m WHERE source_table = target_table
        UNION ALL SELECT id, 'target_table is no identifier' FROM m WHERE NOT regexp_full_match(target_table, '[A-Za-z_$][A-Za-z0-9_$]{0,63}')
        UNION ALL SELECT id, 'sort_order is out of range' FROM m WHERE sort_order NOT BETWEEN 5 AND 45""")),
    "chunk_metrics": (chunk_metrics, "SELECT l_orderkey // 1000 AS chunk, count(*) AS n_rows, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM lineitem GROUP BY 1"),
    "incremental_sync": (incremental_sync, with_tables(["src_orders"], """
        SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN updated_at <= (SELECT max(updated_at) FROM src_orders WHERE updated_at <= TIMESTAMP '1999-01-01') THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, updated_at, o_orderpriority
        FROM src_orders WHERE o_orderstatus <> 'P'""")),
    "sync_tables_report": (sync_tables_report, """
        SELECT 'm1' AS mapping_id, 'completed' AS status, 'full' AS mode, 1::BIGINT AS n_runs, count(*) AS n_rows FROM nation
        UNION ALL SELECT 'm2', 'failed', 'full', 2, 0 UNION ALL SELECT 'm3', 'completed', 'full', 1, count(*) FROM orders WHERE o_totalprice > 100000"""),
    "sync_tables_at_once": (sync_tables_at_once, """
        SELECT 0 AS position, 'm0' AS mapping_id, 'completed' AS status, 'incremental' AS mode, count(*) FILTER (o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 4 <> 0)) AS n_rows,
               count(*) FILTER (o_orderkey % 4 <> 0 OR o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 4 <> 0)) AS in_target FROM orders
        UNION ALL SELECT 1, 'm1', 'completed', 'incremental', 0, count(*) FROM events UNION ALL SELECT 2, 'm2', 'completed', 'full', count(*), count(*) FROM part
        UNION ALL SELECT 3, 'm3', 'completed', 'full', count(*), count(*) FROM customer UNION ALL SELECT 4, 'm4', 'failed', 'full', 0, NULL UNION ALL SELECT 5, 'm5', 'completed', 'full', count(*), count(*) FROM supplier"""),
    "replayed_batches": (replayed_batches, "SELECT event_id % 4 AS batch, count(*) AS n_rows, 4::BIGINT AS n_versions FROM events GROUP BY 1"),
    "continuous_sync": (continuous, "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
}
