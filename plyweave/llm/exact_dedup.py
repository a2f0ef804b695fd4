"""Exact removal of repeated texts, safe where one text stands in a third of all rows.

1. Each task reduces its own equal texts to one row (the aggregate's part before the shuffle).
2. These rows are merged by digest and salt, the salt being the task's number: a text that every task has is one row a
   task, dealt over `salts` groups.
3. The winners of the salts, at most `salts` rows a text, are merged by digest.

Each stage groups by the text itself beside its digest, so equal digests alone never make texts equal. The decisions go
back to the rows by digest: those of texts that make up over a thousandth of all rows, fewer than a thousand texts, are
sent to all tasks; all others are joined, so none of these keys is hot. Digests that different texts share, should there
be any, are joined by text as well. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyweave.llm.common import materialize

#: A text that more than one in so many rows have is decided by broadcast: there are fewer such texts than this.
HOT_SHARE = 1000


def _same(text: Column) -> Column:
    return text


def _named(docs: DataFrame, text: str, id_col: str, normalise: Callable[[Column], Column], name: Callable[[Column], Column]) -> DataFrame:
    """(id, text, sha, digest) of each row; a null text is empty."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(normalise(F.col(f"`{text}`").cast("string")), F.lit("")).alias("text"))
    named = named.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return named.withColumn("digest", name(F.col("sha")))


def _groups(named: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size) of each different text."""
    salted = named.withColumn("salt", F.spark_partition_id() % salts)
    winners = salted.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return winners.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", normalise: Callable[[Column], Column] = _same, salts: int = 32, name: Callable[[Column], Column] = _same) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: which row of those with an equal normalised text stays.

    The one with the largest id stays. Null texts are equal to empty ones. A null id is smaller than any other; where no row
    of a text has an id, keep_id is null and all its rows are marked, as nothing tells them apart; so are rows that repeat
    both id and text (`keep_one` leaves one). Very long texts are compared whole. Other columns are not looked at, whatever
    their names. An empty table gives no rows. `name` gives the digest by which texts are dealt from their SHA-256; a
    worse one costs time and changes nothing.
    """
    named = _named(docs, text, id_col, normalise, name)
    groups = materialize(_groups(named, salts).drop("text"), "texts")
    by_digest = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("rows"))
    total = by_digest.agg(F.sum("rows").alias("rows"), F.max("texts").alias("texts")).first()
    clash = by_digest.filter("texts > 1").select("digest") if (total["texts"] or 0) > 1 else None
    slim = named.select("id", "sha", "digest")
    if clash is not None:
        shared = named.join(clash, "digest", "left_semi")
        by_text = shared.join(_groups(shared, salts), ["digest", "text"]).drop("text")
        groups, slim = groups.join(clash, "digest", "left_anti"), slim.join(clash, "digest", "left_anti")
    is_hot = F.col("group_size") * HOT_SHARE > F.lit(total["rows"] or 0)
    # Fewer than HOT_SHARE rows: their sizes add up to no more than all rows.
    hot = F.broadcast(groups.filter(is_hot))
    found = slim.join(hot, "digest").unionByName(slim.join(hot.select("digest"), "digest", "left_anti").join(groups.filter(~is_hot), "digest"))
    if clash is not None:
        found = found.unionByName(by_text)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", normalise: Callable[[Column], Column] = _same, salts: int = 32) -> DataFrame:
    """`docs` with one row of each normalised text, the one with the largest id; of rows that share it the one with the smallest hash of its columns.

    All columns stay as they are. Odd rows are as in `exact_duplicates`.
    """
    groups = _groups(_named(docs, text, id_col, normalise, _same), salts).select("digest", F.col("keep_id").alias("id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sha = F.sha2(F.coalesce(normalise(F.col(f"`{text}`").cast("string")), F.lit("")).cast("binary"), 256)
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(row.alias("row"), F.unhex(sha).alias("digest"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(*plain).alias("tag"))
    kept = rows.alias("r").join(groups.alias("g"), (F.col("r.digest") == F.col("g.digest")) & F.col("r.id").eqNullSafe(F.col("g.id")), "left_semi")
    # Rows of a key are cut to one in each task before they are shuffled.
    first = kept.withColumn("nth", F.row_number().over(Window.partitionBy("digest", "id").orderBy("tag"))).filter("nth = 1")
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
