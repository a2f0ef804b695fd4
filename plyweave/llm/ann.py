"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: principal axes, rotated so that the signs lose least (iterative quantization), several such
rotations side by side. A code is cut into substrings of 16 bits and each is an index of its own: a table of (place,
value, vec_id, code). By the pigeonhole principle a code within Hamming radius R of the query's is, in at least one of
m substrings, within R // m of it (with fewer for the last ones), so a join of the index with each substring's nearby
values retrieves every code within R. Codes within R are reranked by the true measure.

How many entries a query's probes would touch is counted first, from the number of entries of each value. Queries whose
probes touch more than a share of the table go over the codes of all rows instead, in blocks; both ways give the same
rows. Queries with fewer than k codes within R are compared with all rows.

R is learned: for a bounded sample of queries the true neighbours are found, and R is what covers most of them.
"""

from __future__ import annotations

import functools
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyweave.llm.common import batch_of, materialize, rows_of

#: Rows that are indexed together in a task.
BLOCK = 8192
#: Queries that go to all tasks at a time, and the bytes that their vectors have at most.
QUERIES, QUERY_BYTES = 32_768, 32 << 20
#: Entries of one value of a substring that are joined in one group.
PER_GROUP = 100_000
WIDTH = 16


@dataclass
class Coder:
    mean: np.ndarray
    turns: np.ndarray  # dimensions x bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bytes of the codes of the rows of x."""
        return np.packbits((x - self.mean) @ self.turns > 0, axis=1)


def fit_coder(x: np.ndarray, bits: int, steps: int = 25, seed: int = 3) -> Coder:
    """Codes of at least `bits` bits (a whole number of bytes) from a sample of vectors."""
    rng, mean, d = np.random.default_rng(seed), x.mean(axis=0), x.shape[1]
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(d, d) + 1e-12 * np.eye(d))
    axes = axes[:, ::-1][:, : min(d, bits)]
    z, turns = (x - mean) @ axes, []
    for _ in range(-(-bits // axes.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ v).T
        turns.append(axes @ turn)
    turns = np.concatenate(turns, axis=1)
    return Coder(mean, np.pad(turns, ((0, 0), (0, -turns.shape[1] % 8))))


_NEAR_BYTES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


class MultiIndex:
    """One index for each byte of the codes of a block of rows."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, (self.n, self.m) = codes, codes.shape
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -self.m % 8)))).view(np.uint64)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(self.m)])
        self.starts = np.cumsum(self.counts, axis=1) - self.counts

    def within(self, code: np.ndarray, radius: int, at_least: int) -> np.ndarray:
        """All rows whose codes differ from `code` in at most `radius` bits, or the `at_least` nearest codes if those are more."""
        near, over = divmod(radius, self.m)
        reach = np.where(np.arange(self.m) <= over, near, near - 1)  # one byte must be within its reach
        probes = _NEAR_BYTES[code] <= reach[:, None]
        rows = np.arange(self.n)
        if (self.counts * probes).sum() < self.n:  # else probing touches more than there is: take all, the result is the same
            parts = [self.order[s : s + c, j] for j in range(self.m) for s, c in zip(self.starts[j, probes[j]].tolist(), self.counts[j, probes[j]].tolist(), strict=True) if c]
            rows = np.unique(np.concatenate(parts)) if parts else rows[:0]
        query = np.ascontiguousarray(np.pad(code, (0, -self.m % 8))).view(np.uint64)
        far = np.bitwise_count(self.words[rows] ^ query).sum(axis=1)
        found = rows[far <= radius]
        if len(found) >= min(at_least, self.n):
            return found
        far = np.bitwise_count(self.words ^ query).sum(axis=1)
        return np.flatnonzero(far <= np.partition(far, min(at_least, self.n) - 1)[min(at_least, self.n) - 1])


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), without the vectors that take no part: see `search`."""
    plain = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad: Column = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = plain.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    plain = plain.filter(F.exists("embedding", lambda x: x != 0))
    size = plain.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return plain.filter(F.size("embedding") == (size["n"] if size else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("embedding")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _words_of(batch: pa.RecordBatch, name: str = "words") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, words of the codes) of up to `rows` rows at a time."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            held.append((part.column("vec_id").to_numpy(), _matrix(part), _words_of(part)))
            n += part.num_rows
            if n >= rows:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        use = np.flatnonzero(scores >= least)
    else:
        use = np.arange(len(ids))
    return use[np.lexsort((ids[use], -scores[use]))][:k]


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (vectors * query).sum(axis=1)  # each row summed alone and alike, so equal vectors get equal scores


_FOUND = "query_id long, vec_id long, score double, far int"
_CODED = "vec_id long, embedding array<double>, asks boolean, words array<long>"


def _found(query_ids: list, ids: list, scores: list, far: list) -> pa.RecordBatch:
    sizes = [len(i) for i in ids]
    join = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(query_ids, np.int64), sizes)), join(ids, np.int64), join(scores, np.float64), join(far, np.int32)], names=["query_id", "vec_id", "score", "far"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1)))


def _parts(words: np.ndarray) -> np.ndarray:
    """The substrings of 16 bits of each code."""
    return np.ascontiguousarray(words).view(np.uint16).astype(np.int32)


def _scan(coded: DataFrame, ids: np.ndarray, vectors: np.ndarray, words: np.ndarray, radius: int | None, k: int) -> DataFrame:
    """The k best of each task's rows for the given queries: among codes within the radius, or among all rows if it is None."""
    sent = coded.sparkSession.sparkContext.broadcast((ids, vectors, words))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_vectors, q_words = sent.value
        q_codes = np.ascontiguousarray(q_words).view(np.uint8)
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        best = [none] * len(q_ids)  # of the rows so far: at most k for each query
        for row_ids, x, row_words in _blocks(batches):
            index = MultiIndex(row_words.view(np.uint8)) if radius is not None else None
            for at, (q_id, q, q_code, q_word) in enumerate(zip(q_ids.tolist(), q_vectors, q_codes, q_words, strict=True)):
                rows = np.arange(len(row_ids)) if index is None else index.within(q_code, radius, 0)
                rows = rows[row_ids[rows] != q_id]
                if not len(rows):
                    continue
                scores = _scores(x[rows], q)
                use = _best(row_ids[rows], scores, k)
                rows = rows[use]
                far = np.bitwise_count((row_words[rows] ^ q_word).view(np.uint64)).sum(axis=1, dtype=np.int64)
                joined = [np.concatenate(pair) for pair in zip(best[at], (row_ids[rows], scores[use], far), strict=True)]
                use = _best(joined[0], joined[1], k)
                best[at] = tuple(c[use] for c in joined)
        for at in range(0, len(q_ids), 1024):
            part = best[at : at + 1024]
            yield _found(q_ids[at : at + 1024].tolist(), *([b[i] for b in part] for i in range(3)))

    return coded.mapInArrow(probe, _FOUND)


def _reach(radius: int, m: int) -> np.ndarray:
    """Of codes within the radius at least one of m substrings is within its reach (-1: none needs to be)."""
    near, over = divmod(radius, m)
    return np.where(np.arange(m) <= over, near, near - 1)


def _touched(counts: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each substring and value, how many entries lie within its reach."""
    out = np.zeros_like(counts)
    values = np.arange(counts.shape[1])
    for j, most in enumerate(reach):
        at = [counts[j]] + [np.zeros_like(counts[j])] * max(most, 0)  # entries that differ in exactly 0, 1, ... of the bits so far
        for bit in range(WIDTH):
            at = [a + (at[d - 1][values ^ (1 << bit)] if d else 0) for d, a in enumerate(at)]
        out[j] = sum(at) if most >= 0 else 0
    return out


def _index_of(coded: DataFrame) -> DataFrame:
    """The index: at, value, vec_id, words, a row for each substring of each code."""
    parts = F.flatten(F.transform("words", lambda w: F.array(*[F.shiftright(w, WIDTH * j).bitwiseAND(F.lit(0xFFFF)).cast("int") for j in range(4)])))
    return coded.select(F.posexplode(parts).alias("at", "value"), "vec_id", "words")


def _counts_of(index: DataFrame, m: int) -> np.ndarray:
    """How many entries each value of each substring has: at most m * 65,536 numbers."""
    got, counts = index.groupBy("at", "value").count().toArrow(), np.zeros((m, 1 << WIDTH), np.int64)
    counts[got.column("at").to_numpy(), got.column("value").to_numpy()] = got.column("count").to_numpy()
    return counts


def _probed(coded: DataFrame, index: DataFrame, queries: DataFrame, counts: np.ndarray, radius: int, k: int) -> DataFrame:
    """The k best rows of each query among those whose codes the index gives within the radius."""
    reach = _reach(radius, len(counts))
    near = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint16))
    masks = [np.flatnonzero(near <= most).astype(np.int32) if most >= 0 else np.zeros(0, np.int32) for most in reach]
    step = max(1, 200_000 // max(1, sum(map(len, masks))))
    groups = -(-counts // PER_GROUP)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                ids, words = batch.column("vec_id").to_numpy(), _words_of(batch)
                for at, part in enumerate(_parts(words).T):
                    values = part[:, None] ^ masks[at][None]
                    row, mask = np.nonzero(counts[at][values])  # values that no entry has need no probe
                    value = values[row, mask]
                    n = groups[at][value]
                    group = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, value = np.repeat(row, n), np.repeat(value, n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), _lists(words[row]), pa.array(np.full(len(row), at, np.int32)), pa.array(value.astype(np.int32)), pa.array(group.astype(np.int32))], names=["query_id", "q_words", "at", "value", "part"])

    hot = [(int(a), int(v), int(groups[a, v])) for a, v in np.argwhere(groups > 1)]
    entries = index.withColumn("part", F.lit(0))
    if hot:  # large groups are dealt over several
        sizes = coded.sparkSession.createDataFrame(hot, "at int, value int, n int")
        entries = index.join(sizes, ["at", "value"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("n")), F.lit(0)).cast("int")).drop("n")
    pairs = queries.mapInArrow(probes, "query_id long, q_words array<long>, at int, value int, part int").join(entries, ["at", "value", "part"])
    far = F.aggregate(F.zip_with("words", "q_words", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    near_pairs = pairs.filter((F.col("vec_id") != F.col("query_id")) & (far <= radius)).select("query_id", "q_words", "vec_id", "words").distinct()
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("words").alias("q_words"), F.col("embedding").alias("asked"))
    both = near_pairs.join(coded.select("vec_id", "words", "embedding"), ["vec_id", "words"]).join(asked, ["query_id", "q_words"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            scores = (_matrix(batch) * _words_of(batch, "asked")).sum(axis=1)
            apart = np.bitwise_count((_words_of(batch) ^ _words_of(batch, "q_words")).view(np.uint64)).sum(axis=1, dtype=np.int32)
            yield batch_of(query_id=batch.column("query_id"), vec_id=batch.column("vec_id"), score=scores, far=apart)

    return _top(both.mapInArrow(rerank, _FOUND), k)


def search(table: DataFrame, is_query: Column, k: int = 20, bits: int = 256, covered: float = 0.98, fit_rows: int = 20_000, sample_queries: int = 100, probed_share: float = 1 / 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query, among all other rows.

    Vectors that are null, all zero, hold a null or non-finite component or have another length than most (the longer
    of equally many) take no part, nor do rows without vec_id; repeated rows with the same vec_id and vector count
    once, and a query never finds its own vec_id. Scores are in double precision on the original vectors; ties go to
    the smaller vec_id. Fewer than k other rows: all. No query or an empty table: no rows. Extra columns are ignored.

    The coder is fitted on at most `fit_rows` vectors, the radius on at most `sample_queries` rows that are no queries
    (on queries where all are), both the first by a hash of vec_id; every row is indexed. A query goes through the index
    if its probes and what they touch are at most `probed_share` of all rows, else over all codes, in blocks of bounded size;
    that changes no result. How many went which way is logged. Very long vectors are read whole.
    """
    spark = table.sparkSession
    data = materialize(valid_vectors(table).distinct().withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    order = F.xxhash64("vec_id")
    sample = data.orderBy(order, "vec_id").limit(fit_rows).select("embedding").toArrow()
    if not sample.num_rows or data.filter("asks").isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = np.concatenate([_matrix(b) for b in sample.combine_chunks().to_batches()])
    coder = fit_coder(vectors, bits) if len(vectors) > 1 else Coder(vectors[0], np.ones((vectors.shape[1], 8)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(_words(coder.codes(_matrix(batch))))], names=[*batch.schema.names, "words"])

    coded = materialize(data.mapInArrow(encode, _CODED), "codes")
    queries, n_rows = coded.filter("asks"), coded.count()
    n_queries = queries.count()

    def scan(some: DataFrame, radius: int | None, n: int) -> DataFrame:
        """The k best for each of n queries, a block of them at a time."""
        n_blocks = -(-n // max(1, min(QUERIES, QUERY_BYTES // (8 * vectors.shape[1]))))
        found = None
        for number in range(n_blocks):
            part = some if n_blocks == 1 else some.filter(F.pmod(order, F.lit(n_blocks)) == number)
            got = part.select("vec_id", "embedding", "words").toArrow().combine_chunks()
            if got.num_rows:
                parts = got.to_batches()
                one = _top(_scan(coded, got.column("vec_id").to_numpy(), *(np.concatenate(x) for x in ([_matrix(b) for b in parts], [_words_of(b) for b in parts])), radius, k), k)
                one = one if n_blocks == 1 else materialize(one, "neighbours")  # so that blocks are not held all at once
                found = one if found is None else found.unionByName(one)
        return found

    others = n_queries < n_rows
    fitted = (coded.filter("NOT asks") if others else queries).orderBy(order, "vec_id").limit(sample_queries)
    far = [r["far"] for r in scan(fitted, None, 1).select("far").collect()]  # at most sample_queries * k numbers
    radius = int(np.quantile(far, covered, method="higher")) if far else 0

    index = _index_of(coded)
    m = 4 * len(_words(coder.codes(vectors[:1]))[0])
    counts = _counts_of(index, m)
    touched, reach = spark.sparkContext.broadcast(_touched(counts, _reach(radius, m))), _reach(radius, m)
    n_probes = sum(math.comb(WIDTH, d) for most in reach for d in range(most + 1))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = _parts(_words_of(batch))
                n = n_probes + touched.value[np.arange(m)[None], parts].sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "cost"])

    costed = materialize(queries.mapInArrow(cost, _CODED + ", cost long"), "queries")
    cheap = F.col("cost") <= int(probed_share * n_rows)
    n_cheap = costed.filter(cheap).count()
    logging.getLogger(__name__).info("radius %d of %d bits; %d of %d queries through the index", radius, 64 * m // 4, n_cheap, n_queries)
    ways = [_probed(coded, materialize(index, "index"), costed.filter(cheap), counts, radius, k)] if n_cheap else []
    if n_cheap < n_queries:
        ways.append(scan(costed.filter(~cheap), radius, n_queries - n_cheap))
    found = materialize(functools.reduce(DataFrame.unionByName, ways), "found")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, n_rows - 1)).select(F.col("query_id").alias("vec_id"))
    short = materialize(queries.join(enough, "vec_id", "left_anti"), "short")  # fewer than k codes within the radius
    n_short = short.count()
    if n_short:
        rest = scan(short, None, n_short)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
