"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct words and their first four, five and six letters, hashed to 32 bits; a term
counts once however often it stands. The machine gives each term a weight and a short vector, and scores a text by
the sum of weights plus that of the inner products of all pairs of vectors, so two terms that are harmless alone can
weigh together. Terms are kept if they tell something alone, or if a pair of them tells more than either of the two. The
machine is fitted on a bounded sample of labelled rows; scoring reads every whole text once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyweave.llm.common import crc_mod, materialize, rows_of

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
#: Words that one worker remembers with their terms.
REMEMBERED = 200_000


def word_terms(word: str) -> list[int]:
    """The hashed terms of one lower-case word."""
    return [zlib.crc32(word.encode("utf-8", "surrogatepass"))] + [zlib.crc32(f"{n}:{word[:n]}".encode("utf-8", "surrogatepass")) for n in _PREFIXES if len(word) >= n]


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a whole text, sorted."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((t for w in words for t in word_terms(w)), np.uint32))


@dataclass
class FactorizationMachine:
    known: np.ndarray  # hashed terms that have a weight, sorted
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Score before the logistic function, for rows given as positions in `known`."""
        out = np.full(len(rows), self.bias)
        full = [i for i, r in enumerate(rows) if len(r)]
        if full:
            at, cuts = np.concatenate([rows[i] for i in full]), np.cumsum([0, *(len(rows[i]) for i in full)])[:-1]
            v = self.vectors[at]
            pairs = (np.add.reduceat(v, cuts) ** 2 - np.add.reduceat(v**2, cuts)).sum(axis=1) / 2
            out[full] += np.add.reduceat(self.weight[at], cuts) + pairs
        return out


def telling_terms(rows: list[np.ndarray], labels: np.ndarray, most_terms: int = 8192, pool: int = 2048, least_chi: float = 10.0, least_z: float = 6.0, least_joint: int = 10) -> np.ndarray:
    """The terms worth a weight, sorted: at most `most_terms` alone, and those of telling pairs.

    Alone: in three texts or more, chi-square above `least_chi`; of more, those with the largest. Pairs: of the `pool`
    terms that most toxic texts have (ties to the smaller hash), those that `least_joint` toxic texts or more have together, so many that if the
    pair's rate were that of its more toxic member, or of all texts, they would be `least_z` standard deviations above what is expected.
    """
    every, n_in = np.unique(np.concatenate(rows), return_counts=True)
    toxic, n_toxic = np.unique(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), return_counts=True)
    a = np.zeros(len(every))
    a[np.searchsorted(every, toxic)] = n_toxic
    rate = labels.sum() / len(rows)
    expected = n_in * rate
    chi = (a - expected) ** 2 / expected + (a - expected) ** 2 / np.maximum(n_in - expected, 1e-9)
    alone = np.flatnonzero((n_in >= 3) & (chi > least_chi))
    alone = every[alone[np.lexsort((every[alone], -chi[alone]))][:most_terms]]
    often = np.flatnonzero(a >= least_joint)
    often = np.sort(often[np.lexsort((every[often], -a[often]))][:pool])
    has = np.zeros((len(rows), len(often)), np.float32)
    for i, r in enumerate(rows):
        has[i, np.searchsorted(every[often], np.intersect1d(r, every[often], assume_unique=True))] = 1
    both, both_toxic = has.T @ has, has[labels > 0].T @ has[labels > 0]
    alike = np.clip(np.maximum(a[often] / n_in[often], rate), 1e-6, 1 - 1e-6).astype(np.float32)
    alike = np.maximum(alike[:, None], alike[None])
    z = (both_toxic - both * alike) / np.sqrt(np.maximum(both * alike * (1 - alike), 1e-9))
    found = (z > least_z) & (both_toxic >= least_joint)
    np.fill_diagonal(found, False)
    return np.union1d(alone, every[often[found.any(axis=0)]])


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, factors: int = 4, epochs: int = 40, seed: int = 7, rate: float = 0.2, decay: tuple[float, float] = (0.01, 0.3)) -> FactorizationMachine:
    """Fit to texts given as sorted hashed terms, by steps that shrink with what a parameter has moved; decay is of weights, of vectors. No factors: linear."""
    share = float((labels * importance).sum() / max(importance.sum(), 1e-9))
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    none = FactorizationMachine(np.zeros(0, np.uint32), bias, np.zeros(0), np.zeros((0, factors)))
    if not 0 < labels.sum() < len(labels):
        return none
    known = telling_terms(rows, labels)
    if not len(known):
        return none
    at = [np.searchsorted(known, np.intersect1d(r, known, assume_unique=True)) for r in rows]
    rng, size = np.random.default_rng(seed), np.array([len(x) for x in at])
    w, v, b = np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors)), bias
    moved_w, moved_v, moved_b = np.ones(len(known)), np.ones((len(known), factors)), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(rows), 64):
            use = order[s : s + 64]
            bare, use = use[size[use] == 0], use[size[use] > 0]
            off = float(((1 / (1 + np.exp(-np.clip(b, -30, 30))) - labels[bare]) * importance[bare]).sum())  # rows without terms move the bias
            moved_b += off**2
            b -= rate * off / np.sqrt(moved_b)
            if not len(use):
                continue
            ids, cuts = np.concatenate([at[i] for i in use]), np.cumsum(size[use]) - size[use]
            of = np.repeat(np.arange(len(use)), size[use])
            seen, place = np.unique(ids, return_inverse=True)
            vi = v[ids]
            total = np.add.reduceat(vi, cuts)
            z = b + np.add.reduceat(w[ids], cuts) + (total**2 - np.add.reduceat(vi**2, cuts)).sum(axis=1) / 2
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[use]) * importance[use]
            g = np.bincount(place, slope[of], len(seen)) + decay[0] * w[seen]
            moved_w[seen] += g**2
            w[seen] -= rate * g / np.sqrt(moved_w[seen])
            for f in range(factors):
                g = np.bincount(place, slope[of] * (total[of, f] - vi[:, f]), len(seen)) + decay[1] * v[seen, f]
                moved_v[seen, f] += g**2
                v[seen, f] -= rate * g / np.sqrt(moved_v[seen, f])
            moved_b += slope.sum() ** 2
            b -= rate * slope.sum() / np.sqrt(moved_b)
    return FactorizationMachine(known, float(b), w, v)


def labelled_terms(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """doc_id, toxic, terms (of the whole text, sorted, 32 bits each): the rows to learn from, one for each doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter("toxic in (0, 1)")
    order = F.xxhash64("doc_id")
    picked = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most most_toxic + most_clean ids.
    sample = plain.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = [terms(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "terms"])

    return sample.mapInArrow(run, "doc_id long, toxic int, terms binary")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 6000, most_terms: int = 20_000_000, factors: int = 4, seed: int = 7) -> FactorizationMachine:
    """Fit on at most `most_toxic` + `most_clean` labelled documents, the first by a hash of doc_id, none of them held out.

    Each is learned from with all its terms; where these would be more than `most_terms` in all, the sample has fewer documents. A row counts as its class's
    share of all labelled rows, so the scores fit the labels' own rates. A doc_id that is labelled more than once is toxic
    if any row says so; of several texts that share one, that with the smallest hash is learned from. Null doc_ids, and labels
    that are null or neither 0 nor 1, are none. No labels, or none of one class: the machine has no terms. Other columns are not looked at.
    """
    learned = materialize(labelled_terms(docs, labels, most_toxic, most_clean), "learned-terms").withColumn("order", F.xxhash64("doc_id"))
    sizes = learned.select("order", (F.octet_length("terms") / 4).alias("n")).toArrow().sort_by("order")  # bounded by the number of documents
    within = np.cumsum(sizes.column("n").to_numpy()) <= most_terms
    if not within.all():
        learned = learned.filter(F.col("order") <= (sizes.column("order")[int(within.sum()) - 1].as_py() if within.any() else -(1 << 63)))
    got = learned.drop("order").toArrow().sort_by("doc_id")  # bounded by the three parameters
    known = labels.filter(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    y = got.column("toxic").to_numpy().astype(np.float64)
    rows = [np.frombuffer(x, np.uint32) for x in got.column("terms").to_pylist()]
    total = max(sum(counts.values()), 1)
    importance = np.array([counts[int(v)] / total * len(y) / max((y == v).sum(), 1) for v in y])
    return fit_machine(rows, y, importance, factors, seed=seed)


def margins_of(texts: list[str | None], machine: FactorizationMachine, index: dict[int, int], seen: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Probabilities of whole texts; `index` has the places of known terms, `seen` remembers words between calls."""
    rows = []
    for text in texts:
        found: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            at = seen.get(word)
            if at is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[word] = at = tuple(index[t] for t in word_terms(word) if t in index)
            if at:
                found.update(at)
        rows.append(np.array(sorted(found), np.int64))
    return 1 / (1 + np.exp(-np.clip(machine.margins(rows), -500, 500)))


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for each row of `docs`.

    Null and empty texts, like all texts without a known term, get the fitted bias, about the rate of toxic rows among such. Each
    row is scored by its own text, whatever its doc_id, so repeated rows score alike; a null doc_id counts as ''. Very
    long texts are read whole. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = {int(t): i for i, t in enumerate(model.value.known)}, {}
        for batch in rows_of(batches):
            p = margins_of(batch.column("text").to_pylist(), model.value, index, seen)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(p)], names=["doc_id", "held_out", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """The rows of `docs`, unchanged, whose text scores below 0.5: one pass, nothing is joined.

    Rows are judged as by `score`: null, empty and very long texts, repeated rows and null doc_ids each by their own text. All columns stay,
    whatever their names; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = {int(t): i for i, t in enumerate(model.value.known)}, {}
        for batch in rows_of(batches):
            p = margins_of(batch.column("text").to_pylist(), model.value, index, seen)
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
