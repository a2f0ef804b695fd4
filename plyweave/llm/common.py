"""What the corpus operators share: the shared folder, materialised tables, safe column selection."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that `materialize` has written within the `scratch` that is open, in this thread or task.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a fresh one if all run in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again, so that its lineage ends there and no later job repeats it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """At its end, what `materialize` wrote within is removed, but for what the function it gives has written; after an error all of it.

    What other threads write is theirs. What is kept belongs to the `scratch` around this one, if there is one.
    """
    around, made, kept = _MADE.get(), [], []
    token = _MADE.set(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(made[-1])
        return out

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _MADE.reset(token)
        for path in set(made) - set(kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if around is not None:
            around.extend(kept)


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds about `most_bytes` at most: bounds what a task keeps when texts are long."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def batch_of(**columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    """A record batch of the named columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
