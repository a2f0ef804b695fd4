"""Whitening of embeddings, the principal components by contour integration (FEAST).

1. Vectors become whole numbers; the fit list has each of them once.
2. Sums and products are added up by Spark, a matrix for each task. Whole numbers near the mean are taken off before
   multiplying, so that products of usual vectors are whole and their sums exact, in whatever order they come.
3. Inertia counts: the covariance is brought to tridiagonal form, where the signs of the pivots of V - s tell how many
   eigenvalues are above s. They place cuts in wide gaps, so that every interval between cuts has few eigenvalues and the
   intervals together have the largest ones.
4. For each interval, a task of its own, the spectral projector is a contour integral of the resolvent around it: a few
   complex shifted systems (z - V) Q = Y, weighted by Gauss-Legendre quadrature, give a subspace, Rayleigh-Ritz gives its
   eigenpairs, and this repeats until the residuals are at rounding. An interval is done only with as many eigenpairs as
   the inertia counts say; until then its subspace grows.
5. What a last Rayleigh-Ritz step over all intervals gives whitens every vector.

The covariance, of as many rows as a vector has entries, is all that is ever held whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import materialize, rows_of

#: Eigenvalues that an interval should have at most; quadrature points on its half circle.
PER_INTERVAL, NODES = 8, 8
EPS = np.finfo(float).eps


# --- Eigenpairs of a symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of `v` (Householder reflections)."""
    v = v.copy()
    for k in range(len(v) - 2):
        u = v[k + 1 :, k].copy()
        beside = -math.copysign(np.linalg.norm(u), u[0])
        if beside:
            u[0] -= beside
            u /= np.linalg.norm(u)
            rest = v[k + 1 :, k + 1 :]
            w = rest @ u
            w -= (u @ w) * u
            rest -= 2 * (np.outer(u, w) + np.outer(w, u))
        v[k + 1, k] = beside
    return np.diag(v).copy(), np.diag(v, -1).copy()


def above(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues are above each shift, by the signs of the pivots."""
    diagonal, beside = form
    least = EPS * (np.abs(diagonal).max() + np.abs(beside).max(initial=0)) + np.finfo(float).tiny
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(np.int64)
    for a, b in zip(diagonal[1:], beside, strict=True):
        pivot = a - shifts - b * b / np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot > 0
    return count


def intervals(v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) of neighbouring intervals that together have the `most` largest eigenvalues, or more where these tie.

    Eigenvalues at rounding of the largest are none.
    """
    form, d = tridiagonal(v), len(v)
    bound = np.abs(v).sum(axis=1).max()
    floor = d * EPS * bound
    there = int(above(form, np.array([floor]))[0]) if bound > 0 else 0
    if not there:
        return []
    low, high = np.full(d, -floor), np.full(d, bound * (1 + d * EPS) + floor)
    for _ in range(60):
        middle = (low + high) / 2
        right = above(form, middle) > np.arange(d)
        low, high = np.where(right, middle, low), np.where(right, high, middle)
    value = np.maximum((low + high) / 2, 0)
    gap = np.append(value[:-1] - value[1:], np.inf)
    gap[there - 1] = np.inf  # what follows is at rounding
    cuts, at, need = [], 0, min(most, there)
    while at < need:
        width, last = PER_INTERVAL, -1
        while last < 0 or gap[last] <= 1e-7 * value[0]:
            # The widest gap among the next few, further on if these are one cluster; the last cut is behind all that are needed.
            begin = at if at + width < need else need - 1
            last = begin + int(np.argmax(gap[begin : min(begin + width, there)]))
            width *= 2
        cuts.append(last)
        at = last + 1
    edges = [value[0] + max(0.1 * (value[0] - value[cuts[-1]]), 1e-3 * value[0])]
    for last in cuts:
        edges.append((value[last] + value[last + 1]) / 2 if last + 1 < d else value[last] * 0.9)
    counts = above(form, np.array(edges))
    return [(float(edges[k + 1]), float(edges[k]), int(counts[k + 1] - counts[k])) for k in range(len(cuts))]


def eigenpairs_between(v: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues between `low` and `high`, falling, of which there are `count`, and their unit vectors as columns."""
    d, rng = len(v), np.random.default_rng(seed)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 + points)) * (high - low) / 2
    shifted = [((low + high) / 2 + t) * np.eye(d) - v for t in turn]
    scale, size = max(abs(low), abs(high), np.abs(v).sum(axis=1).max()), min(d, count + max(4, count // 2))
    while True:
        y, best = rng.normal(size=(d, size)), np.inf
        for _ in range(20):
            q = sum(w / 2 * (t * np.linalg.solve(z, y)).real for w, t, z in zip(weights, turn, shifted, strict=True)) if size < d else y
            value, vectors, wrong = rayleigh_ritz(v, q)
            inside = (value > low) & (value < high)
            error = wrong[inside].max(initial=0) / scale if inside.sum() == count else np.inf
            if error <= 4 * EPS or (error <= 1e-12 * math.sqrt(d) and error > best / 2):
                return value[inside], vectors[:, inside]
            if size == d and error < np.inf:
                return value[inside], vectors[:, inside]
            y, best = vectors, min(best, error)
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high} by inertia, {int(inside.sum())} found")
        size = min(d, 2 * size)


def rayleigh_ritz(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of `v` in the span of q's columns, falling, with vectors and the norms of their residuals."""
    q = np.linalg.qr(q)[0]
    small = q.T @ v @ q
    value, turn = np.linalg.eigh((small + small.T) / 2)
    value, vectors = value[::-1], (q @ turn)[:, ::-1]
    return value, vectors, np.linalg.norm(v @ vectors - vectors * value, axis=0)


# --- Over tables


def whole(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): x = floor(scale * entry) + offset of each vector that takes part.

    Those that are null or empty, hold null or non-finite entries or entries beyond 2^56 / scale take no part; nor do those
    of another length than most rows have (ties: the greater length).
    """
    values = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), values.alias("c"))
    good = F.forall("c", lambda e: F.coalesce(F.abs(e) < float(2**56 // scale), F.lit(False)))
    rows = rows.filter(F.col("c").isNotNull() & (F.size("c") > 0) & good)
    lengths = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.filter(F.size("c") == d).select("vec_id", F.transform("c", lambda e: F.floor(e * scale) + F.lit(offset)).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _products(fit: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the rows of y y', where y is what `change` makes of x, and a one behind it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows_of(batches):
            y = change(_matrix(batch.column("x")))
            y = np.hstack([y, np.ones((len(y), 1))])
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "value"])

    # Rows to the driver: the square of a vector's length.
    sums = fit.mapInArrow(add, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    size = 1 + max(r["i"] for r in sums)
    out = np.zeros((size, size))
    for r in sums:
        out[r["i"], r["j"]] = r["value"]
    return out


@dataclass
class Whitener:
    n: int
    near: np.ndarray  # whole numbers next to the means
    rest: np.ndarray  # the sums beyond n times these, whole
    components: np.ndarray  # columns
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the entries of (n x - S)^2; null where that is no long."""
        about = (np.abs(self.centred(x)) * self.n).max(axis=1, initial=0) ** 2 * x.shape[1]
        out = (((x - self.near) * self.n - self.rest) ** 2).sum(axis=1).tolist()
        for k in np.flatnonzero(about > 2.0**62):
            exact = sum((self.n * (int(a) - int(b)) - int(r)) ** 2 for a, b, r in zip(x[k], self.near, self.rest, strict=True))
            out[k] = exact if exact < 2**63 else None
        return pa.array(out, pa.int64())


def fit(x: DataFrame, components: int = 16) -> Whitener | None:
    """The whitener of (vec_id, x), fitted on each different x once; None if there is no row."""
    each = materialize(x.select("x").distinct(), "fit-list")
    sums = each.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    if not sums:
        return None
    n = sums[0]["n"]
    totals = [int(r["s"]) for r in sums]
    near = [(2 * s + n) // (2 * n) for s in totals]
    rest = np.array([s - n * m for s, m in zip(totals, near, strict=True)])
    near = np.array(near)
    total = _products(each, lambda v: (v - near).astype(float))
    v = total[:-1, :-1] / n - np.outer(rest / n, rest / n)
    v = (v + v.T) / 2
    value, vectors = _principal(each, v, components)
    found = Whitener(n, near, rest, vectors, value, float(np.trace(v)))
    if len(value):
        whitened = _products(each, found.whitened)
        mean = whitened[:-1, -1] / n
        found.identity_error = float(np.abs(whitened[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(value))).max())
    return found


def _principal(any_df: DataFrame, v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of `v` and their vectors: a task for each interval."""
    parts = intervals(v, components)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, vectors = eigenpairs_between(v, row["low"], row["high"], row["count"])
                yield pa.RecordBatch.from_arrays([pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], ["vector"])

    tasks = any_df.sparkSession.createDataFrame(parts, "low double, high double, count int").repartition(len(parts), "low")
    # Rows to the driver: as many as components, or as tie with the last one.
    span = np.array([r["vector"] for r in tasks.mapInArrow(solve, "vector array<double>").collect()]).T
    if span.shape[1] != sum(count for _, _, count in parts):
        raise ArithmeticError("eigenvalues are missing")
    value, vectors, _ = rayleigh_ritz(v, span)
    return value[:components], vectors[:, :components]


def transform(x: DataFrame, model: Whitener | None) -> DataFrame:
    """(vec_id, deviation, whitened) of every row of (vec_id, x): whitened has an entry for each component."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = _matrix(batch.column("x"))
            out = model.whitened(rows)
            edges = np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), model.deviation(rows), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(out.ravel()))], ["vec_id", "deviation", "whitened"])

    if model is None:
        return x.select("vec_id", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0)
    return x.mapInArrow(change, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """A row for each vector that takes part and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    What takes part is in `whole`. Rows that repeat or share a vec_id, null ones too, are whitened each; equal vectors count
    once in the fit. Components are numbered from 1 by falling eigenvalue; there are no more than `components`, than
    entries, or than directions with variance (with one vector: none, and no rows). Eigenvalues that tie leave the choice
    of their components open; it is the same for all rows. A deviation that is no long is null. Other columns are not
    looked at. An empty table gives no rows.
    """
    x = whole(vectors)
    model = fit(x, components)
    rows = transform(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = [] if model is None else (model.eigenvalues / model.trace).tolist()
    n, error = (0, 0.0) if model is None else (model.n, model.identity_error)
    share = F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )
