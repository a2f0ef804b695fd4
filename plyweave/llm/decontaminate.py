"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed in k-grams; of every `window - k + 1` consecutive k-gram hashes the smallest
is a fingerprint. Two texts that share `window` words share all k-grams of that span and so its fingerprint: no such
span is missed. Documents' and items' fingerprints are joined, and where they meet, the hit is extended: the document's
windows of that fingerprint are compared word by word with the items' windows, each different window once however many
items have it, so the result is exact; a hash collision costs time only.

Items of fewer words than a window are matched whole: each length below it that the benchmark has is a fingerprint
family of its own, whose k-gram is the whole item.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import batch_of, materialize, rows_of

#: Bytes that make words (digits, letters, all of non-ASCII), with A-Z as a-z; all others separate.
_AS_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_NONE = np.uint64(2**64 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_AS_WORD).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(codes: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; _NONE where the text ends before. left: words from each one to its text's end."""
    h = np.full(len(codes), np.uint64(k))
    for i in range(min(k, len(codes))):
        h[: len(codes) - i] = _mixed((h[: len(codes) - i] ^ codes[i:]) * _FACTOR)
    h = np.minimum(h, _NONE - np.uint64(1))
    h[left < k] = _NONE
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values, from each on; shorter at the end."""
    done = 1
    while done < width:
        step = min(done, width - done)
        shifted = np.full(len(h), _NONE)
        shifted[: max(0, len(h) - step)] = h[step:]
        h, done = np.minimum(h, shifted), done + step
    return h


def _short(codes: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n words from each word on, in the family of items that have just n."""
    return _grams(codes, left, n) ^ np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)


def fingerprints(texts: list[list[bytes]], window: int, k: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, fingerprint) of each winnowed k-gram of all texts, and of each gram of the given short lengths."""
    counts = np.array([len(w) for w in texts], dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.fromiter((zlib.crc32(w) for ws in texts for w in ws), dtype=np.uint64, count=total)
    of = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    least = _least(_grams(codes, left, k), window - k + 1)
    keep = np.flatnonzero((left >= window) & (np.concatenate(([True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])))))
    found = [(of[keep], least[keep])]
    for n in lengths:
        gram = _short(codes, left, n)
        at = np.flatnonzero(left >= n)
        found.append((of[at], gram[at]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def windows_of(words: list[bytes], window: int, k: int, lengths: list[int], only: set[int] | None = None) -> list[tuple[int, int, int, bytes]]:
    """(fingerprint, start, words, text) of each window, and of each gram of the given short lengths; of `only` these fingerprints, if given."""
    if not words:
        return []
    codes, left = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint64, count=len(words)), len(words) - np.arange(len(words))
    wanted = None if only is None else np.fromiter(only, dtype=np.int64, count=len(only))
    out = []
    for n in [window, *lengths]:
        if len(words) < n:
            continue
        fp = _least(_grams(codes, left, k), window - k + 1) if n == window else _short(codes, left, n)
        fp = fp[: len(words) - n + 1].view(np.int64)
        at = np.arange(len(fp)) if wanted is None else np.flatnonzero(np.isin(fp, wanted))
        out += [(f, i, n, b" ".join(words[i : i + n])) for f, i in zip(fp[at].tolist(), at.tolist(), strict=True)]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, share: int = 20, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row per row of `docs`: doc_id, text, n_words, n_hit, n_items, item_ids (array, sorted as strings), contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. `text` is null where nothing is hit (the caller has it).
    Null or empty text has no words and isn't contaminated. Items with null text or no words match nothing; rows of
    `benchmark` that share an item_id are one item with the windows of all. Null item_ids are left out. Rows that share
    a doc_id, or whose doc_id is null, are judged each by its own text; a share of exactly one in `share` is contaminated.
    Very long texts are read whole. No documents: no rows; no benchmark: nothing is hit. Other columns are not looked at,
    whatever their names.

    While the benchmark has at most `most_broadcast` fingerprints, each task drops a document's other fingerprints
    before the join; beyond that size all are shuffled. The rows are the same.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text"))
    items = items.filter(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).distinct()

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
                words = words_of(t)
                n = min(window, len(words))
                found += [(i, fp, size, gram) for fp, _, size, gram in windows_of(words, window, k, [n] if 0 < n < window else [])]
            item_id, fp, n, gram = zip(*found, strict=True) if found else ((), (), (), ())
            yield batch_of(item_id=np.array(item_id, np.int64), fp=np.array(fp, np.int64), n=np.array(n, np.int64), gram=pa.array(gram, pa.binary()))

    test = materialize(items.mapInArrow(of_items, "item_id long, fp long, n long, gram binary").distinct(), "item-windows")
    lengths = sorted(r["n"] for r in test.select("n").distinct().collect() if r["n"] < window)  # fewer than `window` values
    few = test.select("fp").distinct().limit(most_broadcast + 1).count() <= most_broadcast
    known = spark.sparkContext.broadcast(test.select("fp").distinct().toArrow().column("fp").to_numpy() if few else None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = known.value
        if only is not None:
            only = np.sort(only)
            maybe = np.zeros(1 << 20, bool)
            maybe[only & 0xFFFFF] = True
        for batch in rows_of(batches):
            texts = batch.column("text").to_pylist()
            split = [words_of(t) for t in texts]
            of, fp = fingerprints(split, window, k, lengths)
            fp = fp.view(np.int64)
            if only is not None:
                at = np.flatnonzero(maybe[fp & 0xFFFFF])
                at = at[np.isin(fp[at], only)]
                of, fp = of[at], fp[at]
            each: dict[int, set[int]] = {}
            for i, f in zip(of.tolist(), fp.tolist(), strict=True):
                each.setdefault(i, set()).add(f)
            yield batch_of(
                doc_id=batch.column("doc_id"),
                text=pa.array([t if i in each else None for i, t in enumerate(texts)], pa.string()),
                n_words=np.array([len(w) for w in split], np.int64),
                fps=pa.array([list(each.get(i, ())) for i in range(len(texts))], pa.list_(pa.int64())),
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialize(plain.mapInArrow(scan, "doc_id long, text string, n_words long, fps array<long>"), "scanned")
    touched = scanned.filter(F.size("fps") > 0).withColumn("key", F.xxhash64("text")).withColumn("sum", F.crc32(F.col("text").cast("binary")))
    with_fps = touched.select("key", "sum", "text", "fps")
    if not few:
        meets = touched.select("key", "sum", F.explode("fps").alias("fp")).distinct().join(test.select("fp").distinct(), "fp", "left_semi")
        with_fps = with_fps.drop("fps").join(meets.groupBy("key", "sum").agg(F.collect_list("fp").alias("fps")), ["key", "sum"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [windows_of(words_of(t), window, k, lengths, set(f)) for t, f in zip(batch.column("text").to_pylist(), batch.column("fps").to_pylist(), strict=True)]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            _, at, n, gram = zip(*(w for f in found for w in f), strict=True) if len(of) else ((), (), (), ())
            yield batch_of(key=batch.column("key").take(of), sum=batch.column("sum").take(of), at=np.array(at, np.int64), n=np.array(n, np.int64), gram=pa.array(gram, pa.binary()))

    # Equal texts have equal windows, so one row stands for all copies in the joins, and one for each window whatever items have it.
    own = with_fps.mapInArrow(extend, "key long, sum long, at long, n long, gram binary").distinct()
    met = materialize(own.join(test.select("gram").distinct(), "gram", "left_semi"), "windows-met")
    step = lambda s, w: F.struct(F.greatest(s["end"], w["at"] + w["n"]).alias("end"), (s["n"] + F.greatest(F.lit(0), w["at"] + w["n"] - F.greatest(s["end"], w["at"]))).alias("n"))
    spans = F.array_sort(F.collect_list(F.struct("at", "n")))
    n_hit = met.groupBy("key", "sum").agg(spans.alias("spans")).select("key", "sum", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step)["n"].alias("n_hit"))
    ids = met.select("key", "sum", "gram").distinct().join(test.select("gram", "item_id").distinct(), "gram").select("key", "sum", "item_id").distinct()
    ids = ids.groupBy("key", "sum").agg(F.collect_list("item_id").alias("item_ids"))
    none = F.array().cast("array<long>")
    clean = scanned.filter(F.size("fps") == 0).select("doc_id", "text", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"))
    hit = touched.drop("fps").join(n_hit.join(ids, ["key", "sum"]), ["key", "sum"], "left")
    by_text = F.transform(F.array_sort(F.transform("item_ids", lambda i: F.struct(i.cast("string").alias("text"), i.alias("id")))), lambda i: i["id"])
    hit = hit.select("doc_id", "text", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(by_text, none).alias("item_ids"))
    both = clean.unionByName(hit)
    return both.select(
        "doc_id", "text", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, that aren't contaminated, as `decontaminate` judges odd rows.

    Rows with equal doc_id and text go or stay together. Null and empty texts stay. All columns stay, whatever their names.
    """
    judged = decontaminate(docs, benchmark).filter("contaminated")
    bad = materialize(judged.select(F.col("doc_id").alias("bad_id"), F.xxhash64("text").alias("bad_tag")).distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_tag"])
    return docs.join(bad, same, "left_anti")


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns of `decontaminate`'s rows."""
    listed = F.concat_ws(",", F.transform("item_ids", lambda i: i.cast("string")))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
spans AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, (SELECT DISTINCT n FROM sized))),
met AS (SELECT doc_id, p, s.n, item_id FROM spans s JOIN wanted t ON s.gram = t.gram AND s.n = t.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
