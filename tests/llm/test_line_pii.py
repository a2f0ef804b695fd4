from __future__ import annotations

import hashlib
import random
import re

import pytest
from frames import ODD, empty, odd
from oracle import duck, plain
from pyspark.sql import functions as F

from plyweave.llm import line_dedup, pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            value, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind == "card" and (not 14 <= len(digits) <= 19 or sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


EDGES = [
    "", "a@b.c%d@e.f x", "a@b.c_d@e.f a@b", "😀 1.2.3.4.5.6.7.8 é a.b@c.d..e", "999.1.1.1 01.002.0003.4 256.1.1.1.1", "+1((((((((", "a" * 30000, "a@" * 500, "1 " * 1000, "a@b" + ".c" * 5000,
    "+1 (555) 123-4567--- 4111 1111 1111 1111 4111-1111-1111-1111 0", "x4111111111111111y+12025550123", "+123456789012345678", "x.@y.z %@1-.2", "٣.1.1.1.1", "1.1.1.1@2.2.2.2",
]


def test_base_spans_are_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(EDGES)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(docs)).collect()}
    for r in docs.collect():
        want = brute(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["text"][:200]
        assert got[r["doc_id"]]["n_email"] == want.count("email:")


def test_contexts_give_unseen_identifiers_away(spark):
    rows = [(i, f"Please call me at +1 (555) 010-{1000 + i} any time") for i in range(30)]
    rows += [(100, "Please call me at 55501.0X77 any time"), (101, "version 55501.0X78 of the tool"), (102, "we saw 55501.0X77 there"), (103, "call me at noon")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100] == "phone:18:28"
    assert got[102] == "phone:7:17"  # the same identifier elsewhere
    assert got[101] == got[103] == ""
    assert got[5] == "phone:18:35"


def found_in(spark, rows):
    return {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}


def test_addresses_without_digits_and_spaced_numbers(spark):
    rows = [(i, f"write to jane{'x' * (i % 9)}.doe{'y' * (i // 9)}@mail.example for help") for i in range(30)]
    rows += [(50 + i, f"or just ring +44 20 7946 {1000 + i} before six") for i in range(30)]
    rows += [(100, "write to jane(at)mail.example for help"), (101, "write to jane@localhost for help"), (102, "write to someone for help"), (103, "or just ring 020 7946 0958 before six"), (104, "or just ring (020) 7946-0958, before six")]
    got = found_in(spark, rows)
    assert (got[100], got[101], got[102]) == ("email:9:29", "email:9:23", "")
    assert got[103] == "phone:13:26"
    assert got[3] == "email:9:33" and got[53].startswith("phone:13:")


def test_rounds_go_on_until_nothing_is_new(spark):
    """Known numbers give a context's others away, whose next context gives more away: two rounds; one says less."""
    rows = [(i, f"call me at +1 (555) 010-{1000 + i} today") for i in range(30)]
    rows += [(100 + i, f"call me at 7.{i} today and then fax it to 7.{i} please") for i in range(6)]
    rows += [(200, "then fax it to 9.99 please")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda n: {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal_data(df, rounds=n, bar=0.7)).collect()}
    whole = spans(None)
    assert whole[103] == "phone:11:14,phone:40:43" and whole[200] == "phone:15:19"
    assert spans(1)[103] == "phone:11:14,phone:40:43" and spans(1)[200] == ""
    assert spans(0)[103] == ""
    assert whole == spans(9)


def brute_discover(seeds, candidates, support, bar):
    """The graph's rounds by loops over sets."""
    kinds = list(pii.PATTERNS)
    classes = lambda v: {c for c, p in (("l", "[^\\W\\d_]"), ("d", "[0-9]"), ("m", "[^a-zA-Z0-9]")) if re.search(p, v)}
    known = {(v, k) for _, v, k in seeds}
    needs = {k: {c for c in "ldm" if 10 * sum(c in classes(v) for v, x in known if x == k) >= 9 * sum(x == k for _, x in known)} for k in kinds}
    of = {}
    for pattern, value in {(p, v) for p, v, *_ in (*seeds, *candidates)}:
        of.setdefault(pattern, set()).add(value)
    found = {}
    while True:
        seen, doubt = {v for v, _ in known}, {}
        for values in of.values():
            for k in kinds:
                hits = sum((v, k) in known for v in values)
                confidence = hits / (len(values) + 1)
                if len(values) >= support and hits >= support and confidence >= bar / 2:
                    for v in values - seen:
                        if needs[k] <= classes(v):
                            doubt[v, k] = doubt.get((v, k), 1) * (1 - confidence)
        best = {}
        for (v, k), d in doubt.items():
            best[v] = max(best.get(v, (-1, 0, "")), (round(1 - d, 9), -kinds.index(k), k))
        new = {(v, k) for v, (score, _, k) in best.items() if score >= bar}
        if not new:
            return found
        known |= new
        found |= dict(new)


def test_graph_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        value = lambda kind, i: {"email": f"u{i}@x.y", "ip": f"1.2.3.{i}", "card": f"4000{i}", "phone": f"+{i} 1"}[kind]  # noqa: E731, B023
        seeds = [(f"p{rng.randint(0, 6) + 3 * n}", value(k, rng.randint(0, 40)), k) for n, k in enumerate(pii.PATTERNS) for _ in range(90)]
        candidates = [(f"p{rng.randint(0, 24)}", rng.choice([f"c{i}-a", f"c-{i}.b", f"n{i}", f"{i}.{i}"])) for i in (rng.randint(0, 5) for _ in range(60))]
        got = pii.discover(spark.createDataFrame(seeds, "pattern string, value string, kind string"), spark.createDataFrame(candidates, "pattern string, value string"), support=4, bar=0.6)
        got = {r["value"]: r["kind"] for r in got.collect()}
        want = brute_discover(seeds, candidates, 4, 0.6)
        assert got == want and want


def test_text_with_very_many_matches(spark):
    """Positions are sums over blocks; candidates that touch base spans are told by order, not by pairs."""
    text = " ".join(f"user{i}@mail{i % 7}.example.com é {i}.5.6.7 x{i}y" for i in range(10_000))
    got = pii.digest(pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    want = brute(text)
    assert got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got["n_email"] == 10_000
    assert got["spans"] == want


def test_pii_odd_rows(spark):
    got = pii.digest(pii.find_personal_data(odd(spark))).collect()
    assert len(got) == len(ODD)
    assert [r["spans"] for r in got if r["n_ip"]] == ["ip:35:42"]
    assert pii.find_personal_data(empty(spark)).count() == 0


@pytest.mark.parametrize("operator", [lambda d: pii.digest(pii.find_personal_data(d)), lambda d: line_dedup.remove_boilerplate(d)])
def test_no_python_on_the_executors(spark, operator):
    plan = operator(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_agree_with_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = line_dedup.digest(line_dedup.remove_boilerplate(docs, n_lines="n_lines", n_removed="n_removed"))
    assert got.agg(F.sum("n_removed")).first()[0] > 0
    assert plain(got.toPandas()) == plain(duck(line_dedup.ORACLE_SQL, "/root/testdata/sf0.01"))


def test_short_lines_count_too(spark):
    docs = spark.createDataFrame([(i, f"ok\n\n{i}\n \t", f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got == {i: ("ok\n" if not i else "") + f"\n{i}\n \t" for i in range(9)}


def test_rows_without_id_keep_one_line(spark):
    same = [(None, "one line for all", f"s{i}", 1, "x") for i in range(12)]
    other = [(None, f"one line for some\n{i}", f"s{i}", 2, "y") for i in range(12)]
    docs = spark.createDataFrame(same + other, "doc_id long, text string, source string, n_lines int, n_removed string")
    got = line_dedup.remove_boilerplate(docs, n_lines="n_lines", n_removed="n_removed")
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert got.agg(F.sum("n_removed"), F.sum("n_lines")).first()[:] == (22, 36)
    assert line_dedup.digest(got).count() == 24
    assert line_dedup.remove_boilerplate(docs).filter("text like 'one line for%'").count() == 2


def test_the_text_is_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = line_dedup.remove_boilerplate(docs)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter") :]
    assert len(re.findall(r"text#\d+ AS|row#\d+\.text AS|struct\(", join.split("Relation")[0])) <= 1


def test_near_the_threshold_counts_are_exact(spark):
    rows = [(i, f"line of {n} sites, long enough", f"s{i % n}") for n in (7, 8, 9, 300) for i in range(2 * n)]
    docs = spark.createDataFrame([(j, t, s) for j, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = line_dedup.remove_boilerplate(docs, sites=8).filter("text <> ''").groupBy("text").count()
    assert {int(r["text"].split()[2]): r["count"] for r in got.collect()} == {7: 14, 8: 1, 9: 1, 300: 1}


def test_lines_odd_rows(spark):
    rows = [(i, "boiler plate line of many\nown line number of %d" % i, None, f"s{i}", 1, None, None, None, None) for i in range(20, 30)]
    docs = odd(spark).union(spark.createDataFrame(rows, odd(spark).schema))
    got = line_dedup.remove_boilerplate(docs, n_lines="lines", n_removed="removed")
    assert got.columns == [*docs.columns, "lines", "removed"]
    out = got.collect()
    assert len(out) == len(ODD) + 10
    assert [r["text"] for r in out if r["doc_id"] == 20] == [rows[0][1]]
    assert [(r["text"], r["n_chars"], r["removed"]) for r in out if r["doc_id"] == 21] == [("own line number of 21", 21, 1)]
    assert sorted((r["text"] is None, r["lines"]) for r in out if r["doc_id"] in (2, 3, 4)) == [(False, 1), (False, 3), (True, 0)]
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0
