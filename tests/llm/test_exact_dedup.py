from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from frames import ODD, empty, odd
from oracle import agree
from pyspark.sql import functions as F

from plyweave.llm import exact_dedup
from plyweave.llm import queries as registered

NAMES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows, change=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[change(t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_agrees_with_sql(spark):
    agree(spark, registered.queries()["op12_exact_dedup"], registered.oracle_sql()["op12_exact_dedup"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("size", [0, 1, 32])
def test_digests_that_texts_share(spark, size):
    """With digests of one byte or none at all different texts meet; they stay different."""
    rows = [(i, f"text {i * 7 % 60}" if i % 3 else "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(exact_dedup.exact_duplicates(docs, name=lambda sha: F.substring(sha, 1, size))) == brute(rows)


def test_odd_rows(spark):
    docs = odd(spark)
    want = brute([(r[0], r[1]) for r in ODD])
    assert rows_of(exact_dedup.exact_duplicates(docs)) == want
    assert rows_of(exact_dedup.exact_duplicates(docs.drop("lang").withColumns({c: F.lit("x") for c in ("id", "sha", "digest", "salt", "keep_id", "kept")}))) == want
    one = exact_dedup.keep_one(docs)
    assert one.columns == docs.columns
    assert sorted(r["text"] or "" for r in one.collect()) == sorted({r[1] or "" for r in ODD})
    assert {r["doc_id"] for r in one.collect() if (r["text"] or "") == ODD[5][1] or r["text"] == ODD[6][1]} >= {6}


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert exact_dedup.keep_one(empty(spark)).count() == 0


def test_texts_may_be_changed_before(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a c"), (None, "A C")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(exact_dedup.exact_duplicates(docs, normalise=F.lower)) == brute(rows, str.lower)
    assert sorted(r["text"] for r in exact_dedup.keep_one(docs, normalise=F.lower).collect()) == ["a B", "a c"]


def test_a_third_of_all_rows_is_dealt_out(spark):
    """A hot text leaves each task as one row, and its rows are not shuffled to be told what stays."""
    docs = spark.range(0, 9000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    named = exact_dedup._named(docs, "text", "doc_id", exact_dedup._same, exact_dedup._same)
    salted = named.filter("text = 'hot'").groupBy("digest", F.spark_partition_id().alias("task"), "text").count()
    assert salted.count() == 12
    found = exact_dedup.exact_duplicates(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert found.filter("group_size = 3000 and keep_id = 8997").count() == 3000
    assert found.filter("kept").count() == 6001


def test_no_python_workers(spark):
    plan = exact_dedup.exact_duplicates(odd(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
