"""The incremental sync as a stream: new source files are merged by key as they come."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plyweave.operators.merge import latest_per_key, upsert
from plyweave.sources.versioned import VersionedTable


def merge_batch(target: DataFrame | None, batch: DataFrame, keys: list[str], order_by: str, tiebreak: list[str] | None = None, policy: str | None = None, only_newer: bool = False) -> DataFrame:
    """The target after a batch: the latest row of each of its keys is merged. No target: those rows are it.

    only_newer keeps a target row whose tracking value (then tiebreak) is later, so files that come late can't set it back.
    """
    batch = latest_per_key(batch, keys, order_by, tiebreak)
    if target is None:
        return batch
    if only_newer:
        order = F.struct(*[F.col(c) for c in [order_by, *(tiebreak or [])]])
        later = target.select(*keys, order.alias("_theirs"))
        batch = batch.join(later, keys, "left").filter(F.col("_theirs").isNull() | (order >= F.col("_theirs"))).select(target.columns)
    return upsert(target, batch, keys, policy)


def continuous_sync(spark: SparkSession, source: str, schema: T.StructType, target: VersionedTable, checkpoint: str, keys: list[str], order_by: str, tiebreak: list[str] | None = None, policy: str | None = None, only_newer: bool = True, files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Follow the Parquet files of `source` and merge them into `target`.

    Each batch makes one version at most: the commit says which batch of which stream it has, so a batch that is
    delivered again (the stream ended after the commit, before it noted that) is left out, whatever the policy. The batch is read
    once and kept while it is merged. A target with buckets is rewritten only where a batch has keys; `target.vacuum` removes old
    versions. once: end when all files that are there have been taken (the scheduled form); else keep running.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        # The query's own id: it stays as long as its checkpoint, and a new checkpoint begins a new one.
        name = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        take_batch(target, batch, (name, number), keys, order_by, tiebreak, policy, only_newer)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def take_batch(target: VersionedTable, batch: DataFrame, number: tuple[str, int], keys: list[str], order_by: str, tiebreak: list[str] | None = None, policy: str | None = None, only_newer: bool = True) -> int:
    """Merge a batch, named by its stream and number, once; returns its rows, 0 if the table has had it."""
    kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return target.merge(kept, lambda now, rows: merge_batch(now, rows, keys, order_by, tiebreak, policy, only_newer), batch=number)
    finally:
        kept.unpersist()
