from __future__ import annotations

import hashlib
import random

import numpy as np
from frames import empty, odd
from oracle import agree
from pyspark.sql import functions as F

from plyweave.llm import queries, suffix_dedup
from plyweave.llm.suffix_dedup import anchored, digest, multikey_sort, partitioned, remove_repeats


def brute(rows, span=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if b[p : p + span] in seen:
                gone[p : p + span] = b"\1" * span
            seen.add(b[p : p + span])
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def rows_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in digest(df).collect()}


def test_multikey_sort_is_stable_and_complete():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (200, 4)).astype(np.uint64)
    order, first = multikey_sort(200, 4, lambda level, which: keys[which, level])
    assert order.tolist() == sorted(range(200), key=lambda i: tuple(keys[i]))
    for place, i in enumerate(order):
        assert tuple(keys[order[first[place]]]) == tuple(keys[i]) and first[place] <= place


def test_three_way_partitions_sort():
    rng = np.random.default_rng(3)
    for n, values in ((0, 5), (1, 5), (63, 2), (5000, 3), (5000, 10**9), (3000, 1)):
        run, key = np.sort(rng.integers(0, 4, n)), rng.integers(0, values, n).astype(np.uint64)
        assert partitioned(key, run).tolist() == np.lexsort((key, run)).tolist()


def test_one_lead_on_half_the_suffixes(spark, monkeypatch):
    """Suffixes that begin alike in seven bytes and more are parted by what follows: no bucket is far above the others."""
    from plyweave.llm import suffix_dedup

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=12))
    rows = [(i, " ".join(("the same words " if rng.random() < 0.5 else "") + word() for _ in range(60))) for i in range(150)]
    docs = suffix_dedup._named(spark.createDataFrame([*rows, (150, rows[3][1]), (151, rows[9][1][100:])], "doc_id long, text string"))
    monkeypatch.setattr(suffix_dedup, "_LEAST_DOCS", 150)
    n_bytes = sum(len(t) for _, t in rows)
    cuts, inner = suffix_dedup.splitters_of(docs, 152, n_bytes, 16, 100, 24)
    assert inner is None
    assert len(cuts) >= 8
    leads = [t[a : a + 24].encode() for _, t in rows for a in anchored(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), 100, 24)[2].tolist()]
    sizes = np.bincount(np.searchsorted(cuts, np.array(leads, "S24"), side="right"))
    assert sizes.max() < 4 * len(leads) / 16
    assert rows_of(remove_repeats(docs.select("doc_id", "text"))) == brute(docs.select("doc_id", "text").collect())
    few, many = (sorted(map(tuple, suffix_dedup.repeated_passages(docs, bucket_bytes=b).groupBy("id").agg({"end": "max"}).collect())) for b in (1 << 40, 8_000))
    assert few == many and len(few) >= 2


def test_two_levels_of_splitters(spark, monkeypatch):
    """Few first-level buckets: splitters within them cut on, so that none is over the bound and nothing is dealt anew."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    named, rounds = suffix_dedup._named(docs), []
    all_of = lambda **kw: sorted(map(tuple, suffix_dedup.repeated_passages(named, **kw).select("id", "start", "end").distinct().collect()))
    united = lambda rows: {i: suffix_dedup.united(*np.array([r for r in rows if r[0] == i]).T)[1:] for i in {r[0] for r in rows}}
    want = united(all_of(bucket_bytes=1 << 40))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(suffix_dedup, "_BUCKETS", 3)
    cuts, inner = suffix_dedup.splitters_of(named, docs.count(), n_bytes, 24, 100, 24)
    held = {r["bucket"]: r["leads"] for r in inner.collect()}
    assert 1 <= len(cuts) <= 5 and set(held) <= set(range(len(cuts) + 1)) and 10 < len(cuts) + sum(map(len, held.values())) < 40
    assert all(np.searchsorted(cuts, np.array(leads, "S24"), side="right").tolist() == [b] * len(leads) and leads == sorted(leads) for b, leads in held.items())
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name, put=suffix_dedup.materialize: rounds.append(name) or put(df, name))
    got = united(all_of(bucket_bytes=n_bytes // 24))
    assert rounds.count("repeats") == 1 and "inner-splitters" in rounds
    assert got.keys() == want.keys() and all(np.array_equal(got[i], want[i]) for i in want)


def test_blocks_give_the_same_anchors():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([0, 50, 1200, 1300, 5000])

    def each(block):
        start, n, anchor = anchored(data, ends, 100, 24, block)
        return [(s + i, a) for s, m, a in zip(start.tolist(), n.tolist(), anchor.tolist(), strict=True) for i in range(m)]

    whole = each(1 << 19)
    assert whole == each(97)
    assert [p for p, _ in whole] == [*range(50, 1101), 1200, *range(1300, 4901)]
    assert all(p <= a <= p + 76 for p, a in whole)


def test_random_and_periodic_texts(spark):
    for seed in range(2):
        rng = random.Random(seed)
        base = ["".join(rng.choice("ab") for _ in range(rng.choice([5, 30, 200]))) for _ in range(6)]
        rows = [(i, "".join(rng.choice(base) * rng.choice([1, 1, 3]) for _ in range(rng.randint(0, 6)))) for i in range(50)]
        rows += [(60, "a" * 1500), (61, "é" * 300), (62, None), (63, ""), (64, "é" * 300)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert rows_of(remove_repeats(df)) == brute(rows)
        assert rows_of(remove_repeats(df, 40, 7)) == brute(rows, 40)


def test_table_with_many_buckets(spark):
    from plyweave.llm import suffix_dedup

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(remove_repeats(docs)) == brute(rows)
    named = suffix_dedup._named(docs)
    few, many = (sorted(map(tuple, suffix_dedup.repeated_passages(named, bucket_bytes=b).groupBy("id").agg({"end": "max"}).collect())) for b in (1 << 40, 20_000))
    assert few == many


def test_odd_rows(spark):
    got = digest(remove_repeats(odd(spark))).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert by[2] == by[3] == [(0, 0)]
    assert sorted(by[1]) == [(63, 0), (67, 0), (67, 0)]
    assert by[6][0][0] == by[6][0][1]  # a copy of document 5, as long as it is
    assert by[5][0][1] == by[5][0][0] - len("lang wort und text ")  # all but the first period repeats
    assert digest(remove_repeats(empty(spark))).count() == 0


def test_ties_and_ids(spark):
    text = "".join(random.Random(5).choices("abcdef ", k=150))
    rows = [(None, text), (9, text), (9, text), (3, text), (9, text + "!")]
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got == [(0, 150), (3, 0), (9, 150), (9, 150), (9, 150)]


def test_hot_leading_bytes_are_dealt_anew(spark, monkeypatch):
    """A passage that most documents have, between bytes of their own: no task may sort more than the bound at once."""
    from plyweave.llm import suffix_dedup

    rng = random.Random(7)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    hot = own(260)
    rows = [(i, own(rng.randint(0, 150)) + (hot[rng.randint(0, 9) :] if i % 3 else own(90)) + own(rng.randint(0, 150))) for i in range(240)]
    most, rounds = 16_000, []
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name, put=suffix_dedup.materialize: rounds.append(name) or put(df, name))
    docs = suffix_dedup._named(spark.createDataFrame(rows, "doc_id long, text string").repartition(24))
    found = suffix_dedup.repeated_passages(docs, most=most).collect()
    assert len(rounds) > 2
    gone = {i: bytearray(len(t)) for i, t in rows}
    for r in found:
        gone[r["id"]][r["start"] : r["end"]] = b"\1" * (r["end"] - r["start"])
    want = brute(rows)
    for i, t in rows:
        kept = "".join(c for c, g in zip(t, gone[i], strict=True) if not g)
        assert (sum(gone[i]), hashlib.sha256(kept.encode()).hexdigest()) == want[i][1::2]


def test_query_agrees_with_sql(spark):
    agree(spark, queries.op3_suffix_dedup, suffix_dedup.ORACLE_SQL)
