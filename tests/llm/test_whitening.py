from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from plyweave.llm import queries as registered
from plyweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=16):
    """n, deviations by id, eigenvalues, vectors and trace, from whole numbers and a library's eigenvalues."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    z = np.array([[n * a - b for a, b in zip(v, s, strict=True)] for v in fit], dtype=object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in z.T @ z])
    value, vectors = np.linalg.eigh(v)
    order = np.argsort(-value)[:components]
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in x.items()}
    centred = {i: np.array([float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)]) for i, v in x.items()}
    return n, dev, value[order], vectors[:, order], float(np.trace(v)), centred


def check(got, rows, components=16):
    n, dev, value, vectors, trace, centred = brute(rows, components)
    value = value[value > 1e-9 * trace]
    by_row = {}
    for r in got:
        assert r["n"] == n and r["deviation"] == dev[r["vec_id"]]
        assert r["explained"] == pytest.approx(value[r["component"] - 1] / trace, rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        by_row[r["vec_id"], r["component"]] = r["whitened"]
    assert set(by_row) == {(i, k + 1) for i in dev for k in range(len(value))}
    for k in range(len(value)):
        mine = np.array([by_row[i, k + 1] for i in dev])
        want = np.array([centred[i] @ vectors[:, k] for i in dev]) / math.sqrt(value[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7


def test_query_agrees_with_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = registered.queries()["op13_embedding_whitening"](spark, sf_dir)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), rows)


def with_values(values, seed=0):
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return (turn * np.array(values, float)) @ turn.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [3.0, 1.0], [1.0] * 40, [7.0] * 3 + [2.0] * 30, list(np.linspace(1, 2, 64)), [1e6, 1e3, 1, 1e-3] + [1e-5] * 4,
        [4.0, 3, 2] + [0.0] * 20, list(np.exp(-np.arange(50) / 2)), [1 + 1e-10, 1, 1 - 1e-10, 0.5], [0.0] * 5, list(np.linspace(1, 1.0001, 20)) + list(np.linspace(3, 3.0001, 20)),
    ],
)
def test_intervals_hold_the_largest_eigenvalues(values):
    v = with_values(values)
    form, shifts = whitening.tridiagonal(v), np.array([0.3, 1.00005, 2.5, 1001.0])
    assert (whitening.above(form, shifts) == [(np.array(values) > s).sum() for s in shifts]).all()
    parts = whitening.intervals(v, 16)
    want = sorted((x for x in values if x > 1e-13 * max(values)), reverse=True)
    assert sum(c for *_, c in parts) >= min(16, len(want))
    assert all(a[0] == b[1] and a[2] > 0 for a, b in zip(parts, parts[1:], strict=False))
    found, vectors = [], []
    for low, high, count in parts:
        value, columns = whitening.eigenpairs_between(v, low, high, count)
        assert len(value) == count and ((value > low) & (value < high)).all()
        found += list(value)
        vectors.append(columns)
    if found:
        all_vectors = np.hstack(vectors)
        assert np.allclose(found, want[: len(found)], rtol=1e-9, atol=1e-13 * max(values))
        assert np.abs(all_vectors.T @ all_vectors - np.eye(len(found))).max() < 1e-6
        assert np.abs(v @ all_vectors - all_vectors * found).max() < 1e-12 * max(values)


def test_a_missing_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.eigenpairs_between(with_values([1.0, 2, 3]), 1.5, 2.5, 2)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [1, 2, 3, 4, 0]]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    again = [(200 + i, v) for i, v in rows[:10]] + [(300, rows[0][1])] * 0
    df = spark.createDataFrame(rows + bad + again, SCHEMA).selectExpr("*", "vec_id AS x", "'a' AS whitened", "1 AS n")
    got = whitening.whiten(df).collect()
    check(got, rows + again)
    assert {r["component"] for r in got} == {1, 2, 3, 4}  # the fifth entry never changes
    # Repeated rows and rows without an id are whitened each.
    twice = spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), (None, rows[1][1])], SCHEMA)
    assert whitening.whiten(twice).count() == 43 * 4


def test_few_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    two = [(1, [1.0, 2.0]), (2, [2.0, 2.0])]
    check(whitening.whiten(spark.createDataFrame(two, SCHEMA)).collect(), two)


def test_great_numbers(spark):
    """Entries far from each other: products are no whole numbers any more; a deviation that is no long is null."""
    rows = [(i, [1e9 * i, 1.0 + i % 3, -(7.0**i)]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert max(r["identity_error"] for r in got) < 1e-4
    assert any(r["deviation"] is None for r in got)
