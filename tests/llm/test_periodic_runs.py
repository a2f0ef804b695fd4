from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
from frames import ODD, empty, odd
from oracle import agree
from pyspark.sql import functions as F

from plyweave.llm import periodic_runs
from plyweave.llm import queries as registered


def split(text):
    return (text or "").encode().split()


def brute(words, exponent=4, shortest=6):
    """Runs by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(shortest, exponent * q) and end > at:
                found.setdefault((at, end + q), q)
            at = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = planted(doc_id, split(text))
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if not runs else 1000 * best[1] // best[2]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(collapse(words, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_every_difference_is_covered_once():
    pairs = [(b - a) % periodic_runs.PERIOD for a, b in itertools.permutations(periodic_runs.COVER, 2)]
    assert sorted(pairs) == list(range(1, periodic_runs.PERIOD))


def numbered(docs):
    """Documents of numbers from 1 in one array, with zeros around them."""
    words = np.concatenate([[0], *[np.append(d, 0) for d in docs]]).astype(np.int64)
    count = np.array([len(d) for d in docs])
    return words, np.cumsum(count + 1) - count, count


def test_extensions_agree_with_loops():
    rng = random.Random(3)
    for letters, longest in ((1, 90), (2, 300), (3, 700)):
        docs = []
        for _ in range(12):
            base = [rng.randint(1, letters) for _ in range(rng.randint(0, longest))]
            docs.append(base + base[: rng.randint(0, len(base))] * rng.randint(0, 3))
        words, begin, count = numbered(docs)
        doc = np.repeat(np.arange(len(begin) + 1), np.append(count + 1, 1))
        found = periodic_runs.Extensions(words, doc)
        pairs = [(b + x, b + y) for b, n in zip(begin, count, strict=True) if n > 1 for x, y in (rng.sample(range(n + 1), 2) for _ in range(200))]
        for (i, j), got in zip(pairs, found(*np.array(pairs).T), strict=True):
            want = 0
            while words[i + want] == words[j + want] != 0:
                want += 1
            assert got == want


def test_runs_agree_with_every_period_at_every_place():
    rng = random.Random(5)
    for exponent, shortest in ((4, 6), (2, 2), (3, 20)):
        docs = [[1] * n for n in range(12)]
        for _ in range(120):
            out = []
            while len(out) < rng.randint(0, 400):
                unit = [rng.randint(1, rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 7, 30, 33, 70]))]
                out += (unit * rng.randint(1, 8))[: rng.randint(1, 9 * len(unit))]
            docs.append(out)
        words, begin, count = numbered(docs)
        got = list(zip(*periodic_runs.runs_in(words, begin, count, exponent, shortest), strict=True))
        want = [(b + s, b + s + n, q) for b, d in zip(begin, docs, strict=True) for s, n, q in sorted(brute(d, exponent, shortest), key=lambda r: (r[0], r[2]))]
        assert got == want
        assert len(want) > 60


def test_chunks_of_the_grid_agree(monkeypatch):
    rng = random.Random(7)
    docs = [[rng.randint(1, 2) for _ in range(n)] * 5 for n in (3, 40, 111)]
    whole = periodic_runs.runs_in(*numbered(docs), 4, 6)
    monkeypatch.setattr(periodic_runs, "_PLACES", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.runs_in(*numbered(docs), 4, 6), strict=True))


def test_query_agrees_with_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("n_chars < 20000").collect()
    chosen = {r["doc_id"] for r in docs}
    got = registered.queries()["op11_periodic_runs"](spark, sf_dir)
    assert got.columns == COLUMNS
    assert rows_of(got.filter(F.col("doc_id").isin(list(chosen)))) == sorted((digest(*r) for r in docs), key=repr)
    assert got.filter("n_runs > 0").count() > 5


def test_agrees_with_sql(spark):
    agree(spark, registered.queries()["op11_periodic_runs"], registered.oracle_sql()["op11_periodic_runs"], "/root/testdata/sf0.01")


def test_made_texts(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1000, 1200):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 40))] + ["x"] * rng.randint(0, 9) + ["é", "b c"] * rng.randint(0, 5)
        rows.append((i, rng.choice(["", " ", "\n\x0b"]) + rng.choice([" ", "  ", "\t\x0c"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.repeat_tails(docs)))
    assert rows_of(got) == sorted((digest(*r) for r in rows), key=repr)


def test_odd_rows(spark):
    got = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.repeat_tails(odd(spark).withColumns({c: F.lit(1) for c in ("words", "runs", "h", "n", "a")}))))
    long = {r[1] for r in ODD if len(r[1] or "") > 9999}
    cheap = [r for r in ODD if r[1] not in long]
    assert [r for r in rows_of(got) if r[0] not in (5, 6)] == sorted((digest(*r[:2]) for r in cheap), key=repr)
    # 6,000 times four words
    (one,) = periodic_runs.find_runs(odd(spark).filter("doc_id = 5")).collect()
    assert [tuple(r) for r in one["runs"]] == [(0, 24000, 4)]
    assert one["collapsed"] == "lang wort und text"


def test_empty_table(spark):
    assert periodic_runs.digest(periodic_runs.find_runs(periodic_runs.repeat_tails(empty(spark)))).count() == 0
