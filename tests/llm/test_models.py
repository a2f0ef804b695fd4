from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from frames import ODD, empty, odd
from pyspark.sql import functions as F

from plyweave.llm import ann, language, toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.train(spark, docs, labels)
    got = toxicity.score(docs, machine).join(labels, "doc_id").filter("held_out").toPandas()
    hit = got[got.predicted == 1]
    assert (got[got.toxic == 1].predicted == 1).mean() > 0.88
    linear = toxicity.score(docs, toxicity.train(spark, docs, labels, factors=0)).join(labels, "doc_id").filter("held_out").toPandas()
    # No pair tells more than its terms in these rows, so vectors gain nothing; what they cost stays within two rows of 825.
    assert (got.predicted != got.toxic).sum() <= (linear.predicted != linear.toxic).sum() + 2
    assert (got.predicted == got.toxic).mean() > 0.97
    assert (hit.toxic == 1).mean() > 0.97
    assert set(got.held_out) == {True} and got.score.between(0, 1).all()
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score(docs, machine).filter("predicted = 0").count()


def test_machine_learns_an_interaction():
    pair = [np.array([11, 22], np.uint32), np.array([11], np.uint32), np.array([22], np.uint32), np.array([33], np.uint32)]
    rows = [pair[i % 4] for i in range(800)]
    y = np.array([float(i % 4 == 0) for i in range(800)])
    m = toxicity.fit_machine(rows, y, np.ones(800))
    p = m.margins([np.searchsorted(m.known, np.intersect1d(r, m.known)) for r in pair])
    assert p[0] > 0 > p[1] and p[2] < 0
    assert m.vectors[0] @ m.vectors[1] > 0.1


def test_terms_that_tell_nothing_alone():
    """Texts with both terms or with neither are toxic, among common and rare terms that say nothing: a linear machine can't tell, the pair's vectors do."""
    rng, rows, y = np.random.default_rng(4), [], []
    for i in range(1600):
        a, b = bool(i & 1), bool(i & 2)
        other = rng.choice(np.arange(100, 300), 20, replace=False)
        rows.append(np.unique(np.concatenate([[11] * a, [22] * b, other, [1000 + i]])).astype(np.uint32))
        y.append(float(a == b))
    y = np.array(y)
    for term in (11, 22):
        has = np.array([term in r for r in rows])
        assert y[has].mean() == y[~has].mean() == 0.5
    known = toxicity.telling_terms(rows[:1200], y[:1200])
    assert {11, 22} <= set(known.tolist()) and len(known) < 20
    right = {}
    for factors in (4, 0):
        m = toxicity.fit_machine(rows[:1200], y[:1200], np.ones(1200), factors)
        p = m.margins([np.searchsorted(m.known, np.intersect1d(r, m.known)) for r in rows[1200:]])
        right[factors] = ((p > 0) == (y[1200:] > 0)).mean()
    assert right[4] > 0.99 and right[0] < 0.8


def test_whole_query_against_brute_force(spark):
    """Every score is the logistic function of bias, weights and all pairs of vectors, term by term."""
    from plyweave.llm import queries

    docs, labels = (queries.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    m = toxicity.train(spark, docs, labels)
    place = {int(t): i for i, t in enumerate(m.known)}
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        words = set(toxicity._WORD.findall((r["text"] or "").lower()))
        at = sorted({place[t] for w in words for t in toxicity.word_terms(w) if t in place})
        z = m.bias + sum(m.weight[i] for i in at) + sum(float(m.vectors[i] @ m.vectors[j]) for i in at for j in at if i < j)
        row = got[r["doc_id"]]
        assert abs(row["score"] - 1 / (1 + np.exp(-z))) < 1e-9
        assert row["predicted"] == (row["score"] >= 0.5) and row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    again = toxicity.train(spark, docs.repartition(7), labels.repartition(3))
    assert (again.known == m.known).all() and np.array_equal(again.weight, m.weight) and np.array_equal(again.vectors, m.vectors)


def test_margins_are_the_factorization_machines():
    rng = np.random.default_rng(3)
    m = toxicity.FactorizationMachine(np.arange(6, dtype=np.uint32), 0.3, rng.normal(size=6), rng.normal(size=(6, 2)))
    rows = [np.array([0, 2, 5]), np.array([], int), np.array([1])]
    want = [0.3 + m.weight[[0, 2, 5]].sum() + sum(m.vectors[a] @ m.vectors[b] for a, b in ((0, 2), (0, 5), (2, 5))), 0.3, 0.3 + m.weight[1]]
    assert np.allclose(m.margins(rows), want)


def test_whole_texts_are_learned_from(spark, monkeypatch):
    """A long text's terms all count, wherever their hashes lie; a bound on all terms takes documents, not parts of them."""
    long = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) + "zzzz" for i in range(9000))
    rows = [(i, f"{long if i % 40 == 0 else 'plain words here'} {'vileword' if i % 2 else 'kindword'}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_machine", lambda rows, *a, fit=toxicity.fit_machine, **k: seen.append(rows) or fit(rows, *a, **k))
    machine = toxicity.train(spark, docs, labels)
    assert max(map(len, seen[0])) > 27_000 and len(seen[0]) > 280
    got = toxicity.score(docs, machine).join(labels, "doc_id").filter("predicted = toxic").count()
    assert got == 400
    toxicity.train(spark, docs, labels, most_terms=40_000)
    assert 0 < len(seen[1]) < len(seen[0]) and sum(map(len, seen[1])) <= 40_000
    assert {len(r) for r in seen[1]} <= {len(r) for r in seen[0]}
    assert toxicity.train(spark, docs, labels, most_terms=0) is not None


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None), (4, 0)], "doc_id long, toxic int")
    machine = toxicity.train(spark, odd(spark), labels)
    got = toxicity.score(odd(spark), machine).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(odd(spark), toxicity.train(spark, odd(spark), labels.limit(0))).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.score(empty(spark), machine).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 2000 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_codewords_stand_apart():
    four = language.codewords(4)
    assert four.shape == (4, 7)
    assert min((four[a] != four[b]).sum() for a in range(4) for b in range(a)) == 4  # any one wrong bit is mended
    many = language.codewords(40)
    assert min((many[a] != many[b]).sum() for a in range(40) for b in range(a)) >= 5
    assert language.codewords(1).shape[0] == 1


def test_a_wrong_bit_is_corrected():
    code = language.codewords(4)
    codes = language.Codes(list("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.ones(7))
    margins = 3.0 * code[2][None].repeat(7, 0)
    margins[np.arange(7), np.arange(7)] *= -0.3
    best, score, lead = codes.decode(margins)
    assert set(best) == {2} and (score > 0.5).all() and (lead > 0).all()
    _, _, lead = codes.decode(np.zeros((1, 7)))
    assert lead[0] < 0.2


def test_decoding_against_loops():
    """The nearest codeword by the sum over its bits of trust times logistic loss; of equal ones the first language."""
    rng = np.random.default_rng(6)
    code = language.codewords(5)
    codes = language.Codes(list("abcde"), code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]), rng.random(code.shape[1]))
    margins = np.concatenate([rng.normal(0, 2, (200, code.shape[1])), np.zeros((1, code.shape[1]))])
    best, score, lead = codes.decode(margins)
    for row, m in enumerate(margins):
        cost = [sum(float(codes.trust[j]) * np.log1p(np.exp(-m[j] * word[j])) for j in range(len(m))) for word in code]
        weights = [np.exp(min(cost) - c) for c in cost]
        first, second = sorted(weights, reverse=True)[:2]
        assert abs(weights[best[row]] - 1) < 1e-9
        assert abs(score[row] - first / sum(weights)) < 1e-9 and abs(lead[row] - (first - second) / sum(weights)) < 1e-9
    assert best[-1] == 0


def test_language_query_against_loops(spark):
    """The whole query: which rows are learned from, n-grams counted one by one, bits by sums over buckets, the nearest codeword."""
    from plyweave.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codes, rows = language.train(docs), docs.collect()
    usable = [r for r in rows if r["lang"] is not None and re.search(r"[^\W\d_]", r["text"] or "") and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    assert codes.languages == sorted({r["lang"] for r in usable})
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)

    def bucket(gram):
        h = len(gram) * 0x9E3779B1 % 2**32
        for b in gram:
            h = (h ^ b) * 0x01000193 % 2**32
        return (h ^ h >> 15) % language.BUCKETS

    for r in [x for x in rows if x["n_chars"] < 4000]:
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0)
            continue
        data, counts = f" {r['text'].lower()} ".encode(), {}
        for n in (2, 3):
            for i in range(len(data) - n + 1):
                b = bucket(data[i : i + n])
                counts[b] = counts.get(b, 0) + 1
        total = sum(counts.values())
        margins = codes.bias + sum(np.sqrt(c / total) * codes.weight[b].astype(float) for b, c in counts.items())
        cost = [sum(t * np.log1p(np.exp(-m * bit)) for t, m, bit in zip(codes.trust, margins, word, strict=True)) for word in codes.code]
        weights = [np.exp(min(cost) - c) for c in cost]
        best = max(range(len(cost)), key=lambda k: weights[k])
        assert mine["lang_pred"] == codes.languages[best] or abs(sorted(weights)[-1] - sorted(weights)[-2]) < 1e-3
        assert abs(mine["score"] - max(weights) / sum(weights)) < 1e-3


def test_language_odd_rows(spark):
    got = language.identify(odd(spark), language.train(odd(spark))).collect()
    assert len(got) == len(ODD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4, 7)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] == 5} <= {"de", "en", "fr"}
    assert language.train(empty(spark)) is None
    assert {r["lang_pred"] for r in language.identify(odd(spark), None).collect()} == {"und"}


def exact(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        rest = np.flatnonzero(ids != ids[i])
        score = (x[rest] * x[i]).sum(axis=1)
        out[int(ids[i])] = [int(ids[rest[j]]) for j in np.lexsort((ids[rest], -score))[:k]]
    return out


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    want = exact(ids, x, 20)
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    by = got.groupby("query_id").vec_id.apply(list)
    assert np.mean([len(set(by[q]) & set(want[q])) / 20 for q in want]) > 0.95
    assert (got.groupby("query_id").size() == 20).all()
    assert got.groupby("query_id").score.apply(lambda s: (s.diff().dropna() <= 0).all()).all()
    row, place = got.iloc[0], dict(zip(ids, range(len(ids)), strict=True))
    assert row.score == (x[place[row.vec_id]] * x[place[row.query_id]]).sum()


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (20, 8)).astype(np.uint8)
    codes = np.concatenate([base, *[base ^ (rng.random((20, 8)) < 0.3) * (1 << rng.integers(0, 8, (20, 8))).astype(np.uint8) for _ in range(10)]]).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 5, 7, 8, 12, 20):
        for q in base:
            far = np.bitwise_count(codes ^ q).sum(axis=1)
            assert set(index.within(q, radius, 1)) >= set(np.flatnonzero(far <= radius))
            assert set(np.flatnonzero(far <= radius)) == set(index.within(q, radius, 0)) or not (far <= radius).any()


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.6, 0.8]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (4, [-1.0, 0.5]), (4, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 20), (0, 4, 4), (20, 1, 0), (20, 2, 2), (20, 3, 3), (20, 4, 4)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = lambda: sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect()))
    whole = rows()
    monkeypatch.setattr(ann, "QUERIES", 8)
    assert rows() == whole


def test_entries_within_reach_are_counted():
    rng = np.random.default_rng(2)
    values, reach = rng.integers(0, 1 << 16, (3, 400)), np.array([2, 1, -1])
    counts = np.stack([np.bincount(v, minlength=1 << 16) for v in values])
    got = ann._touched(counts, reach)
    for j in range(3):
        for v in (*values[j][:20].tolist(), 0, 65535):
            assert got[j, v] == (np.bitwise_count(values[j] ^ v) <= reach[j]).sum()


def clustered(spark, seed=4):
    """60 tight clusters of 40 vectors and a few vectors alone: learned radii are small, and probes are few."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.repeat(rng.normal(size=(60, 32)), 40, axis=0) + 0.02 * rng.normal(size=(2400, 32)), 0.5 * rng.normal(size=(40, 32))])
    ids = rng.permutation(len(x))
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), ids, x


@pytest.mark.parametrize("per_group", [100_000, 7])
def test_index_and_scan_give_the_same(spark, monkeypatch, caplog, per_group):
    df, ids, x = clustered(spark)
    monkeypatch.setattr(ann, "PER_GROUP", per_group)
    rows = lambda share: sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, probed_share=share).collect()))
    with caplog.at_level("INFO", "plyweave.llm.ann"):
        through, over = rows(1e9), rows(0)
    shares = [r.args[2:] for r in caplog.records if "through the index" in r.msg]
    assert shares == [(122, 122), (0, 122)]
    assert through == over
    want = exact(ids, x, 20)
    by = {}
    for q, _, v, _ in through:
        by.setdefault(q, []).append(v)
    assert {len(v) for v in by.values()} == {20} and by.keys() == want.keys()
    assert np.mean([len(set(by[q]) & set(want[q])) / 20 for q in want]) > 0.9


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(1)
    letters = [chr(0x4E00 + 7 * i) for i in range(250)]
    rows = [(4 * n, "".join(rng.choice([letters[n % 250], "x"], 40)), f"l{n % 250:03d}") for n in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    codes = language.train(docs, most_rows=500)
    assert len(codes.languages) == 250
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, codes).collect()}
    assert np.mean([got[d] == lang for d, _, lang in rows]) > 0.9
