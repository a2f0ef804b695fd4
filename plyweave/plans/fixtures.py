"""Tables that the registered queries derive from the given ones: a replication pair and a sync service's own tables.

Each has a Spark form and the same as SQL, for the comparison of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for the present in all queries.
AS_OF = "2024-01-31 00:00:00"
#: Texts of log messages, one for each class of error in order; the last fits two classes.
MESSAGES = [
    "Deadlock found when trying to get lock",
    "dial tcp: connection refused",
    "Access denied for user",
    "context deadline exceeded",
    "Unknown column c9 in field list",
    "Data too long for column c1",
    "Duplicate entry 7 for key",
    "write failed: no space left on device",
    "runtime: out of memory",
    "something else happened",
    "Lock wait timeout exceeded; try restarting transaction",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "updated_at")


def drifted(source: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """A target that has drifted: rows missing, stale and set to null, and rows that the source doesn't have."""
    k = F.col(key)
    changed = source.filter(k % 5 != 0).withColumns({number: F.when(k % 7 == 0, F.col(number) + 1).otherwise(F.col(number)), text: F.when(k % 11 == 0, None).otherwise(F.col(text))})
    return changed.unionByName(source.filter(k % 100 == 1).withColumn(key, k + 10_000_000))


def target_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifted(source_orders(spark, sf_dir), "o_orderkey", "o_totalprice", "o_orderstatus")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select(key.alias("id"), F.col("n_name").alias("name"), region.alias("source_connection_id"), ((region + 1) % 5).alias("target_connection_id"), (key % 3 != 0).alias("enabled"))


def mappings(spark: SparkSession, sf_dir: str, configs_in_use: int = 30) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), (key % configs_in_use).alias("sync_config_id"), F.col("p_name").alias("source_table"), F.col("p_brand").alias("target_table"),
        F.when(key % 2 == 0, "full").otherwise("incremental").alias("sync_mode"), (F.col("p_size") > 10).alias("enabled"), F.col("p_size").alias("sort_order"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, value = F.col("event_id"), F.floor("value").cast("long")
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    df = table(spark, sf_dir, "events").select(i.alias("id"), (F.col("user_id") % 25).alias("config_id"), status.alias("status"), F.col("ts").alias("start_time"), F.col("ts").alias("created_at"), value.alias("v"))
    tables, rows = 1 + F.col("id") % 5, F.when(F.col("id") % 4 == 0, F.lit(0)).otherwise(F.col("v") * 10)
    df = df.withColumn("end_time", F.when(~F.col("status").isin("pending", "running"), F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("v").cast("decimal(18,6)"))))
    df = df.withColumns({"total_tables": tables, "completed_tables": F.when(F.col("status") == "completed", tables).otherwise(F.col("id") % tables), "total_rows": rows, "processed_rows": F.least(F.col("v") * 7, rows)})
    return df.drop("v").withColumn("error", F.when(F.col("status") == "failed", "boom"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.array(*[F.lit(m) for m in MESSAGES])
    return table(spark, sf_dir, "events").select(i.alias("id"), (i % 1000).alias("job_id"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.element_at(text, (i % len(MESSAGES) + 1).cast("int")).alias("message"), F.col("ts").alias("created_at"))


_MESSAGES_SQL = ", ".join(f"'{m}'" for m in MESSAGES)

#: The same tables as common table expressions.
SQL = {
    "src_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate AS updated_at, o_orderpriority FROM orders",
    "tgt_orders": """
      SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, updated_at, o_orderpriority
      FROM src_orders WHERE o_orderkey % 5 <> 0
      UNION ALL
      SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, updated_at, o_orderpriority FROM src_orders WHERE o_orderkey % 100 = 1""",
    "delta_orders": "SELECT * FROM src_orders WHERE updated_at > TIMESTAMP '1999-01-01' AND updated_at <= (SELECT max(updated_at) FROM src_orders)",
    "connections": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "configs": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS source_connection_id, (n_regionkey + 1) % 5 AS target_connection_id, n_nationkey % 3 <> 0 AS enabled FROM nation",
    "mappings": "SELECT p_partkey AS id, p_partkey % 30 AS sync_config_id, p_name AS source_table, p_brand AS target_table, CASE WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'incremental' END AS sync_mode, p_size > 10 AS enabled, p_size AS sort_order FROM part",
    "jobs": """
      SELECT id, config_id, status, start_time, created_at, end_time, total_tables, completed_tables, total_rows, least(v * 7, total_rows) AS processed_rows, error
      FROM (
        SELECT *, CASE WHEN status NOT IN ('pending', 'running') THEN start_time + to_seconds(v) END AS end_time,
               CASE WHEN status = 'completed' THEN total_tables ELSE id % total_tables END AS completed_tables,
               CASE WHEN id % 4 = 0 THEN 0 ELSE v * 10 END AS total_rows, CASE WHEN status = 'failed' THEN 'boom' END AS error
        FROM (
          SELECT event_id AS id, user_id % 25 AS config_id, ts AS start_time, ts AS created_at, CAST(floor(value) AS BIGINT) AS v, 1 + event_id % 5 AS total_tables,
                 CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status
          FROM events))""",
    "logs": f"SELECT event_id AS id, event_id % 1000 AS job_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, ([{_MESSAGES_SQL}])[event_id % {len(MESSAGES)} + 1] AS message, ts AS created_at FROM events",
}
_NEEDS = {"tgt_orders": ["src_orders"], "delta_orders": ["src_orders"]}


def with_tables(names: list[str], query: str) -> str:
    """The query with the named derived tables before it."""
    wanted = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + " " + query
