"""History, statistics and repair of sync jobs. `as_of` stands for the present everywhere, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages of repaired and expired jobs.
_STUCK = "Task timeout - automatically marked as failed after %d minutes. Original error: %s"
_EXPIRED = "Job expired (pending for more than 24 hours)"


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows from `offset` on, at most `limit` (0 or less: 50), in an order that leaves no ties."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(limit if limit > 0 else 50)


def job_history(jobs: DataFrame, configs: DataFrame, connections: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Jobs with the names of their config and its connections, newest first. Jobs without any of them are left out.

    The newest jobs are only known after the joins, but those are against dimensions, which the planner broadcasts where
    they are small, and order and limit are one top-k.
    """
    side = lambda name: connections.select(F.col("id").alias(f"{name}_connection_id"), F.col("name").alias(f"{name}_name"))
    named = configs.select(F.col("id").alias("config_id"), F.col("name").alias("config_name"), "source_connection_id", "target_connection_id")
    named = named.join(side("source"), "source_connection_id").join(side("target"), "target_connection_id")
    joined = jobs.join(named, "config_id").withColumn("connection_name", F.concat("source_name", F.lit(" -> "), "target_name"))
    columns = ["id", "config_id", "config_name", "connection_name", "status", "start_time", "end_time", "total_tables", "completed_tables", "total_rows", "processed_rows"]
    return page(joined.select(*columns), [F.desc("start_time"), F.asc("id")], limit, offset)


def mappings_per_config(configs: DataFrame, mappings: DataFrame) -> DataFrame:
    """config_id, config_name, n_mappings; configs without a mapping have 0."""
    counts = mappings.groupBy(F.col("sync_config_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return configs.join(counts, "id", "left").select(F.col("id").alias("config_id"), F.col("name").alias("config_name"), F.coalesce("n", F.lit(0)).alias("n_mappings"))


def _seconds(start: str, end: str) -> Column:
    return F.timestamp_diff("SECOND", F.col(start), F.col(end))


def sync_statistics(jobs: DataFrame, as_of: Column, newest: int | None = 1000) -> DataFrame:
    """One row of totals over the newest jobs (None: all).

    average_minutes divides the time of all ended jobs by the number of completed ones, null without any; error_rate is
    a percentage of all jobs; jobs_per_hour counts those started in the 24 hours before `as_of`.
    """
    some = jobs if newest is None else jobs.orderBy(F.desc("start_time"), "id").limit(newest)
    status = lambda s: F.count_if(F.col("status") == s)
    done = status("completed")
    return some.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        done.alias("completed_jobs"),
        status("failed").alias("failed_jobs"),
        status("running").alias("running_jobs"),
        F.coalesce(F.sum("processed_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("completed_tables").cast("long")), F.lit(0)).alias("total_tables"),
        F.when(done > 0, F.coalesce(F.sum(_seconds("start_time", "end_time")), F.lit(0)) / 60.0 / done).alias("average_minutes"),
        F.when(F.count(F.lit(1)) > 0, status("failed") * 100.0 / F.count(F.lit(1))).alias("error_rate"),
        F.max(F.when(F.col("status") == "completed", F.col("end_time"))).alias("last_completed"),
        (F.count_if(F.col("start_time") > as_of - F.expr("INTERVAL 24 HOURS")) / 24.0).alias("jobs_per_hour"),
    )


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    """status, n_jobs, earliest_start, latest_start."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"), F.min("start_time").alias("earliest_start"), F.max("start_time").alias("latest_start"))


def progress(done_rows: Column, all_rows: Column, done_tables: Column, all_tables: Column) -> Column:
    """Percent done: by rows if their total is known, else by tables, else 0."""
    return F.when(all_rows > 0, done_rows * 100.0 / all_rows).when(all_tables > 0, done_tables * 100.0 / all_tables).otherwise(0.0)


def job_progress(jobs: DataFrame) -> DataFrame:
    """id, status, percent."""
    return jobs.select("id", "status", progress(F.col("processed_rows"), F.col("total_rows"), F.col("completed_tables"), F.col("total_tables")).alias("percent"))


def progress_by_job(tables: DataFrame) -> DataFrame:
    """job_id, total_rows, processed_rows, n_tables, n_completed, percent from one row per job and table."""
    summed = tables.groupBy("job_id").agg(F.sum("total_rows").alias("total_rows"), F.sum("processed_rows").alias("processed_rows"), F.count(F.lit(1)).alias("n_tables"), F.count_if(F.col("status") == "completed").alias("n_completed"))
    return summed.withColumn("percent", progress(F.col("processed_rows"), F.col("total_rows"), F.col("n_completed"), F.col("n_tables")))


def with_status(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs of a status; order them by start_time, descending, where that matters."""
    return jobs.filter(F.col("status") == status)


def recent_failures(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest failed jobs."""
    return page(with_status(jobs, "failed"), [F.desc("start_time"), F.asc("id")], limit)


def latest_logs(logs: DataFrame, job_id: int | None = None, limit: int = 20) -> DataFrame:
    """The newest log rows, of one job or of all."""
    return page(logs if job_id is None else logs.filter(F.col("job_id") == job_id), [F.desc("created_at"), F.desc("id")], limit)


def stuck_jobs(jobs: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Running jobs that started more than `minutes` whole minutes ago, with running_minutes."""
    running = with_status(jobs, "running").withColumn("running_minutes", F.timestamp_diff("MINUTE", F.col("start_time"), as_of))
    return running.filter(F.col("running_minutes") > minutes)


def repair_stuck(jobs: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """All jobs, stuck ones as failed at `as_of` with a message that keeps the original error."""
    stuck = (F.col("status") == "running") & (F.timestamp_diff("MINUTE", F.col("start_time"), as_of) > minutes)
    stuck = F.coalesce(stuck, F.lit(False))
    error = F.format_string(_STUCK, F.lit(minutes), F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit("none")))
    return jobs.withColumns({"end_time": F.when(stuck, as_of).otherwise(F.col("end_time")), "error": F.when(stuck, error).otherwise(F.col("error")), "status": F.when(stuck, "failed").otherwise(F.col("status"))})


def expire_pending(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Pending jobs with action: expire (created more than `hours` ago, now failed) or resubmit."""
    old = F.col("created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    pending = with_status(jobs, "pending").withColumn("action", F.when(old, "expire").otherwise("resubmit"))
    gone = F.col("action") == "expire"
    return pending.withColumns({"status": F.when(gone, "failed").otherwise(F.col("status")), "end_time": F.when(gone, as_of).otherwise(F.col("end_time")), "error": F.when(gone, _EXPIRED).otherwise(F.col("error"))})
