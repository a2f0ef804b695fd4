"""Incremental pulls: tracking columns, high-water marks, checkpoints, and the sync that puts them together."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyweave.operators.database import DatabaseTable
from plyweave.operators.merge import latest_per_key
from plyweave.sources import files
from plyweave.sources.tables import predicate
from plyweave.sources.versioned import VersionedTable

# Names of tracking columns, best first; those of one line rank alike.
TRACKING = [["updated_at"], ["modified_at"], ["last_modified"], ["update_time", "modify_time"]]
_CHECKPOINT = "mapping_id string, column string, kind string, hi_ts timestamp_ntz, hi_id long, updated_at timestamp"


def tracking_column(schema: T.StructType, id_column: str | None = None) -> tuple[str, str]:
    """(column, kind: ts or id) that tells changed rows: a name above, or a time column with 'update' in its name, or the id.

    Of equals the one that stands first in the schema. ValueError if there is none.
    """
    times = (T.TimestampType, T.TimestampNTZType)
    for rank, names in enumerate(TRACKING):
        for f in schema:
            if f.name.lower() in names or (rank == len(TRACKING) - 1 and isinstance(f.dataType, times) and "update" in f.name.lower()):
                return f.name, "ts"
    if id_column is None:
        raise ValueError("no tracking column, and no id column is given")
    return id_column, "id"


def high_water_mark(df: DataFrame, column: str) -> DataFrame:
    """One row: hi, the largest value of the whole table, filtered rows included; null if there is none."""
    return df.agg(F.max(column).alias("hi"))


def high_water_marks(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, column, hi (as text), n_rows of each named (table, tracking column)."""
    one = lambda name, df, c: df.agg(F.max(c).cast("string").alias("hi"), F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), F.lit(c).alias("column"), "hi", "n_rows")
    return reduce(DataFrame.unionByName, [one(name, df, c) for name, (df, c) in tables.items()])


def pull_changes(df: DataFrame, column: str, lo: Column | None, hi: Column, where: str | None = None) -> DataFrame:
    """Rows with lo < column <= hi that pass the filter; lo None: from the start. Rows without a tracking value don't come."""
    bound = F.col(column) <= hi
    return df.filter((bound if lo is None else (F.col(column) > lo) & bound) & predicate(where))


def parse_id_mark(text: str | None) -> int:
    """The mark of an id pull; empty or unreadable ones are 0."""
    try:
        return int((text or "").strip())
    except ValueError:
        return 0


def sync_lag(tables: dict[str, tuple[DataFrame, str]], checkpoints: DataFrame, kind: str = "id") -> DataFrame:
    """table, hi_source (its largest value), hi_mark, n_behind (rows beyond the mark) of each table with a mark of `kind` (id or ts).

    Of a table that is behind only rows beyond the mark are read, where files tell; of others the column. Without a mark
    an id counts from 0 and a time from the beginning. Three values a table come to the driver.
    """
    hi = "hi_id" if kind == "id" else "hi_ts"
    rows = checkpoints.filter(F.col("mapping_id").isin(list(tables))).groupBy("mapping_id").agg(F.max(hi).alias("hi")).collect()
    marks, found = {r["mapping_id"]: r["hi"] for r in rows}, []
    for name, (df, column) in tables.items():
        mark = marks.get(name)
        beyond = F.col(column).isNotNull() if mark is None and kind == "ts" else F.col(column) > F.lit(0 if mark is None else mark)
        top, n = df.filter(beyond).agg(F.max(column), F.count(F.lit(1))).first()
        found.append((name, top if n else high_water_mark(df, column).first()["hi"], mark, n))
    value = "long" if kind == "id" else "timestamp_ntz"
    return checkpoints.sparkSession.createDataFrame(found, f"table string, hi_source {value}, hi_mark {value}, n_behind long")


class Checkpoints:
    """Marks by mapping, for what has no commit of its own and for comparing many mappings (`sync_lag`).

    A mark is a small file, made only if there is none of its number, so of two writers one sees the other's mark and
    begins again; a mark never moves back. Each write removes all but the last two files of its mapping.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, mapping_id: str) -> str:
        return f"{self.path}/{hashlib.sha256(mapping_id.encode()).hexdigest()[:32]}"

    def all(self) -> DataFrame:
        """The last mark of each mapping."""
        rows = self.spark.createDataFrame([], f"{_CHECKPOINT}, number long")
        if files.exists(self.spark, self.path):
            stored = self.spark.read.schema(f"{_CHECKPOINT}, number long").option("recursiveFileLookup", "true").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(self.path)
            rows = rows.unionByName(stored)
        return latest_per_key(rows, ["mapping_id"], "number").drop("number")

    def _last(self, mapping_id: str) -> tuple[int, dict | None]:
        found = files.names(self.spark, self._folder(mapping_id))
        return (int(found[-1].split(".")[0]), json.loads(files.read(self.spark, f"{self._folder(mapping_id)}/{found[-1]}"))) if found else (-1, None)

    def get(self, mapping_id: str) -> dict | None:
        """mapping_id, column, kind, hi_ts and hi_id of the last mark."""
        row = self._last(mapping_id)[1]
        return row and row | {"hi_ts": row["hi_ts"] and dt.datetime.fromisoformat(row["hi_ts"])}

    def put(self, mapping_id: str, column: str, kind: str, hi, back: bool = False) -> None:
        """Move the mark to `hi`, unless it is there or further already. `back` moves it anyway, so that rows are pulled again."""
        while True:
            number, old = self._last(mapping_id)
            text = hi.isoformat(timespec="microseconds") if kind == "ts" else None
            if old and not back and (old["column"], old["kind"]) == (column, kind) and (old["hi_ts"] >= text if kind == "ts" else old["hi_id"] >= hi):
                return
            row = {"mapping_id": mapping_id, "column": column, "kind": kind, "hi_ts": text, "hi_id": None if kind == "ts" else hi, "number": number + 1}
            row["updated_at"] = dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds")
            try:
                files.create(self.spark, f"{self._folder(mapping_id)}/{number + 1:012d}.json", json.dumps(row))
            except files.Conflict:
                continue
            for name in files.names(self.spark, self._folder(mapping_id))[:-2]:
                files.delete(self.spark, f"{self._folder(mapping_id)}/{name}")
            return


@dataclass
class SyncResult:
    mode: str
    n_rows: int
    lo: object
    hi: object


def incremental_sync(source: DataFrame, target: VersionedTable | DatabaseTable, keys: list[str], checkpoints: Checkpoints, mapping_id: str, where: str | None = None, policy: str | None = None, id_column: str | None = None, overlap: str | None = None, tiebreak: list[str] | None = None, versions: bool = True) -> SyncResult:
    """Pull what changed since the mapping's mark, merge it by key, then store the new mark.

    The new mark is the source's largest tracking value before anything is read, so rows that are committed meanwhile
    come next time. Without a mark, or without a target, all filtered rows up to it replace the target. The mark is a part
    of the data's commit: both are there or neither, and of two syncs that start from one version the second fails, so
    it can't set the mark back. `checkpoints` gets it afterwards, for reports; its mark is used where the target has none. `overlap` (an
    interval such as "10 minutes") reads that much before the mark again, for rows that were committed late; merged by key they do no harm.

    Of several versions of a key the latest stays, by the tracking value, then `tiebreak`, then the other columns;
    `versions` off says that the source has each key once, which saves the full load a shuffle. A target with buckets
    is rewritten only where the delta has keys.
    """
    column, kind = tracking_column(source.schema, id_column)
    hi, now = high_water_mark(source, column).first()["hi"], target.current()
    if hi is None and now is not None:
        return SyncResult("nothing", 0, None, None)
    lo = _mark(target.mark(mapping_id), column, kind)
    if lo is None and (kept := checkpoints.get(mapping_id)):
        lo = kept["hi_ts"] if kind == "ts" else kept["hi_id"]
    top = hi if lo is None or now is None else max(hi, lo)
    marks = {} if top is None else {mapping_id: {"column": column, "kind": kind, "hi": top.isoformat() if kind == "ts" else top}}
    if lo is None or now is None:
        rows = source.filter(predicate(where)) if hi is None else source.filter((F.col(column).isNull() | (F.col(column) <= F.lit(hi))) & predicate(where))
        mode, lo, n = "full", None, target.publish(latest_per_key(rows, keys, column, tiebreak) if versions else rows, marks=marks, keys_of=rows)
    else:
        since = F.lit(lo) - F.expr(f"INTERVAL {overlap}") if overlap and kind == "ts" else F.lit(lo)
        delta = pull_changes(source, column, since, F.lit(hi), where)
        mode, n = "incremental", target.upsert(delta, keys, policy, column, tiebreak, marks=marks)
    if top is not None:
        checkpoints.put(mapping_id, column, kind, top)
    return SyncResult(mode, n, lo, hi)


def _mark(stored: dict | None, column: str, kind: str):
    """What a commit has as the mark of this column, as a value."""
    if not stored or (stored["column"], stored["kind"]) != (column, kind):
        return None
    return dt.datetime.fromisoformat(stored["hi"]) if kind == "ts" else stored["hi"]
