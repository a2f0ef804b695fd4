"""Registered queries on job history, statistics, repair and error logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyweave.functions import errors
from plyweave.operators import jobs as ops
from plyweave.plans.fixtures import AS_OF, as_of, configs, connections, jobs, logs, mappings, with_tables

_NOW = f"TIMESTAMP '{AS_OF}'"
_MINUTES = f"CAST(floor((epoch({_NOW}) - epoch(start_time)) / 60) AS BIGINT)"


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.job_history(jobs(spark, sf_dir), configs(spark, sf_dir), connections(spark, sf_dir), 50, 25)


def mappings_per_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mappings_per_config(configs(spark, sf_dir), mappings(spark, sf_dir, 20))


def sync_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sync_statistics(jobs(spark, sf_dir), as_of())


def sync_statistics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sync_statistics(jobs(spark, sf_dir), as_of(), None)


def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.jobs_by_status(jobs(spark, sf_dir))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.job_progress(jobs(spark, sf_dir))


def progress_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.progress_by_job(jobs(spark, sf_dir).withColumn("job_id", F.col("id") % 300))


def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recent_failures(jobs(spark, sf_dir)).select("id", "config_id", "start_time", "error")


def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_status(jobs(spark, sf_dir), "running").select("id", "config_id", "start_time")


def latest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_logs(logs(spark, sf_dir))


def logs_of_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_logs(logs(spark, sf_dir), job_id=7, limit=50)


def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stuck_jobs(jobs(spark, sf_dir), as_of()).select("id", "start_time", "running_minutes")


def repair_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.repair_stuck(jobs(spark, sf_dir), as_of()).select("id", "status", "end_time", "error")


def expire_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.expire_pending(jobs(spark, sf_dir), as_of()).select("id", "status", "end_time", "error", "action")


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_classes(logs(spark, sf_dir)).select("id", "type", "severity", "retryable", "suggestion")


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_report(logs(spark, sf_dir).withColumn("table", F.concat(F.lit("t"), (F.col("job_id") % 5).cast("string"))), "table")


def _case(value) -> str:
    tests = [(" OR ".join("contains(lower(message), '" + t.replace("'", "''") + "')" for t in texts), value(kind, severity, retry)) for kind, texts, severity, retry in errors.RULES]
    return "CASE " + " ".join(f"WHEN {test} THEN {v}" for test, v in tests) + f" ELSE {value(*errors.UNKNOWN)} END"


_TYPE, _SEVERITY, _RETRY = _case(lambda k, s, r: f"'{k}'"), _case(lambda k, s, r: f"'{s}'"), _case(lambda k, s, r: str(r))
_ADVICE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in errors.ADVICE.items()) + " END"


def _statistics_sql(limit: str) -> str:
    return with_tables(["jobs"], f"""
        SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status = 'failed') AS failed_jobs,
               count(*) FILTER (status = 'running') AS running_jobs, coalesce(sum(processed_rows), 0)::BIGINT AS total_rows, coalesce(sum(completed_tables), 0)::BIGINT AS total_tables,
               CASE WHEN count(*) FILTER (status = 'completed') > 0 THEN coalesce(sum(CAST(epoch(end_time) - epoch(start_time) AS BIGINT)), 0) / 60.0 / count(*) FILTER (status = 'completed') END AS average_minutes,
               CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'failed') * 100.0 / count(*) END AS error_rate,
               max(end_time) FILTER (status = 'completed') AS last_completed, count(*) FILTER (start_time > {_NOW} - INTERVAL 24 HOURS) / 24.0 AS jobs_per_hour
        FROM (SELECT * FROM jobs ORDER BY start_time DESC, id {limit})""")


ENTRIES = {
    "job_history": (job_history, with_tables(["connections", "configs", "jobs"], """
        SELECT j.id, j.config_id, c.name AS config_name, s.name || ' -> ' || t.name AS connection_name, j.status, j.start_time, j.end_time, j.total_tables, j.completed_tables, j.total_rows, j.processed_rows
        FROM jobs j JOIN configs c ON j.config_id = c.id JOIN connections s ON c.source_connection_id = s.id JOIN connections t ON c.target_connection_id = t.id
        ORDER BY j.start_time DESC, j.id LIMIT 50 OFFSET 25""")),
    "mappings_per_config": (mappings_per_config, "SELECT n_nationkey AS config_id, n_name AS config_name, count(p_partkey) AS n_mappings FROM nation LEFT JOIN part ON p_partkey % 20 = n_nationkey GROUP BY ALL"),
    "sync_statistics": (sync_statistics, _statistics_sql("LIMIT 1000")),
    "sync_statistics_all": (sync_statistics_all, _statistics_sql("")),
    "jobs_by_status": (jobs_by_status, with_tables(["jobs"], "SELECT status, count(*) AS n_jobs, min(start_time) AS earliest_start, max(start_time) AS latest_start FROM jobs GROUP BY 1")),
    "job_progress": (job_progress, with_tables(["jobs"], "SELECT id, status, CAST(CASE WHEN total_rows > 0 THEN processed_rows * 100.0 / total_rows WHEN total_tables > 0 THEN completed_tables * 100.0 / total_tables ELSE 0 END AS DOUBLE) AS percent FROM jobs")),
    "progress_by_job": (progress_by_job, with_tables(["jobs"], """
        SELECT *, CAST(CASE WHEN total_rows > 0 THEN processed_rows * 100.0 / total_rows WHEN n_tables > 0 THEN n_completed * 100.0 / n_tables ELSE 0 END AS DOUBLE) AS percent
        FROM (SELECT id % 300 AS job_id, sum(total_rows)::BIGINT AS total_rows, sum(processed_rows)::BIGINT AS processed_rows, count(*) AS n_tables, count(*) FILTER (status = 'completed') AS n_completed FROM jobs GROUP BY 1)""")),
    "recent_failures": (recent_failures, with_tables(["jobs"], "SELECT id, config_id, start_time, error FROM jobs WHERE status = 'failed' ORDER BY start_time DESC, id LIMIT 10")),
    "running_jobs": (running_jobs, with_tables(["jobs"], "SELECT id, config_id, start_time FROM jobs WHERE status = 'running'")),
    "latest_logs": (latest_logs, with_tables(["logs"], "SELECT * FROM logs ORDER BY created_at DESC, id DESC LIMIT 20")),
    "logs_of_job": (logs_of_job, with_tables(["logs"], "SELECT * FROM logs WHERE job_id = 7 ORDER BY created_at DESC, id DESC LIMIT 50")),
    "stuck_jobs": (stuck_jobs, with_tables(["jobs"], f"SELECT id, start_time, {_MINUTES} AS running_minutes FROM jobs WHERE status = 'running' AND {_MINUTES} > 30")),
    "repair_stuck": (repair_stuck, with_tables(["jobs"], f"""
        SELECT id, CASE WHEN stuck THEN 'failed' ELSE status END AS status, CASE WHEN stuck THEN {_NOW} ELSE end_time END AS end_time,
               CASE WHEN stuck THEN 'Task timeout - automatically marked as failed after 30 minutes. Original error: ' || coalesce(nullif(error, ''), 'none') ELSE error END AS error
        FROM (SELECT *, status = 'running' AND {_MINUTES} > 30 AS stuck FROM jobs)""")),
    "expire_pending": (expire_pending, with_tables(["jobs"], f"""
        SELECT id, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN old THEN {_NOW} ELSE end_time END AS end_time,
               CASE WHEN old THEN 'Job expired (pending for more than 24 hours)' ELSE error END AS error, CASE WHEN old THEN 'expire' ELSE 'resubmit' END AS action
        FROM (SELECT *, created_at < {_NOW} - INTERVAL 24 HOURS AS old FROM jobs WHERE status = 'pending')""")),
    "error_classes": (error_classes, with_tables(["logs"], f"SELECT *, {_ADVICE} AS suggestion FROM (SELECT id, {_TYPE} AS type, {_SEVERITY} AS severity, {_RETRY} AS retryable FROM logs)")),
    "error_report": (error_report, with_tables(["logs"], f"""
        SELECT *, CASE WHEN severity = 'low' THEN 'warn' ELSE 'error' END AS level
        FROM (SELECT {_TYPE} AS type, {_SEVERITY} AS severity, 't' || (job_id % 5) AS "table", count(*) AS n_errors FROM logs GROUP BY ALL)""")),
}
