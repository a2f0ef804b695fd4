"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of bits. For each bit a linear logistic classifier over hashed byte n-grams (two and
three long) predicts it; decoding chooses the language whose codeword costs least, each bit's loss counted by how
reliable its classifier was. Where the second language costs nearly as little, the row is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyweave.llm.common import batch_of, crc_mod, rows_of

_LETTER = re.compile(r"[^\W\d_]")
BUCKETS = 4096
_CHUNK = 1 << 20


def _slots(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the byte n-gram from each position on."""
    h = np.full(len(data) - n + 1, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
    for i in range(n):
        h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.intp)


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)


def profile(text: str) -> np.ndarray:
    """Share of each bucket among the n-grams of a whole text."""
    data, out = _bytes_of(text), np.zeros(BUCKETS)
    for n in (2, 3):
        out += np.bincount(_slots(data, n), minlength=BUCKETS)
    return out / out.sum()


def codewords(classes: int, bits: int = 15, seed: int = 5) -> np.ndarray:
    """Rows of +1 and -1, one for each class: all different splits for up to four, else the best spread of random ones."""
    if classes <= 4:
        return np.array([[1 if c == 0 or (s >> c - 1) & 1 else -1 for s in range(2 ** (classes - 1) - 1)] for c in range(classes)]).reshape(classes, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = max(bits, int(np.ceil(6 * np.log2(classes))))
    for _ in range(200):
        code = rng.choice([-1, 1], (classes, bits))
        code[0, np.abs(code.sum(axis=0)) == classes] *= -1
        apart = (bits - code @ code.T) // 2 + bits * np.eye(classes, dtype=int)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its score, margin to the second) of each row of bit margins."""
        loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -50, 50)))
        cost = (loss * self.trust).sum(axis=2)
        likely = np.exp(-(cost - cost.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        ranked = np.sort(likely, axis=1)
        return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if likely.shape[1] > 1 else 0)


def fit_codes(profiles: np.ndarray, langs: list[str], steps: int = 150) -> Codes:
    languages = sorted(set(langs))
    code = codewords(len(languages))
    y = code[[languages.index(x) for x in langs]] if code.size else np.zeros((len(langs), 0))
    x = np.sqrt(profiles)
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -50, 50))) / len(x)
        g_w = x.T @ g + 1e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * g_w, 0.99 * m2 + 0.01 * g_w**2
        w -= 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        b -= 3 * g.sum(axis=0)
    wrong = ((x @ w + b) * y <= 0).mean(axis=0) if y.size else np.zeros(0)
    return Codes(languages, code, w.astype(np.float32), b, np.log((1 - np.clip(wrong, 0.01, 0.49)) / np.clip(wrong, 0.01, 0.49)) / np.log(99))


def train(docs: DataFrame, per_language: int = 800, most_rows: int = 6_000) -> Codes | None:
    """Fit on at most `per_language` rows of each lang, and about `most_rows` in all; None if there is no such row.

    Every lang is learned; where there are so many that `per_language` of each were more than `most_rows`, each has an
    equal share, of one row at least. Rows that are held out, have no lang or no letter are never used. Which rows: the
    first by a hash of doc_id.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    plain = plain.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2))
    counts = plain.groupBy("lang").count().collect()  # as many rows as languages
    per_language = max(1, min(per_language, most_rows // max(1, len(counts))))
    # Somewhat more than per_language rows of each: a hash below a bound that its count gives; then cut to size exactly.
    enough = max(1.5 * per_language, per_language + 6 * per_language**0.5 + 10)
    bounds = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, enough / r["count"])))]) if counts else None
    if bounds is None:
        return None
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    some = plain.filter(order < bounds[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            known = [t is not None and bool(_LETTER.search(t)) for t in batch.column("text").to_pylist()]
            some = batch.filter(pa.array(known, pa.bool_()))
            profiles = [profile(t).astype(np.float32).tobytes() for t in some.column("text").to_pylist()]
            yield batch_of(doc_id=some.column("doc_id"), lang=some.column("lang"), profile=pa.array(profiles, pa.binary()))

    got = some.mapInArrow(run, "doc_id long, lang string, profile binary")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "profile")
    got = got.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).orderBy("lang", "n").collect()
    if not got:
        return None
    return fit_codes(np.stack([np.frombuffer(bytes(r["profile"]), np.float32) for r in got]).astype(np.float64), [r["lang"] for r in got])


def identify(docs: DataFrame, codes: Codes | None, gap: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous (the best language leads by less than `gap`), for each row of `docs`.

    Null texts and texts without a letter, and all texts if no language could be learned, are `und` with score 0 and
    ambiguous. Each row is judged by its own text, whatever its doc_id, so repeated rows are judged alike. Of equally near
    languages the first by name is predicted. Very long texts are read whole. An empty table gives no rows. lang, source
    and other columns are not looked at, whatever their names; doc_id only tells held_out, a null one as ''.
    """
    model = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in rows_of(batches):
            texts = batch.column("text").to_pylist()
            lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            use = [i for i, t in enumerate(texts) if m is not None and t and _LETTER.search(t)]
            if use:
                x = np.sqrt(np.stack([profile(texts[i]) for i in use]).astype(np.float32))
                best, sure, lead = m.decode(x @ m.weight + m.bias)
                for i, k in zip(use, best, strict=True):
                    lang[i] = m.languages[k]
                score[use], doubt[use] = sure, lead < gap
            kept = {c: batch.column(c) for c in ("doc_id", "held_out")}
            yield batch_of(**kept, lang_pred=pa.array(lang, pa.string()), score=score, ambiguous=doubt)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
