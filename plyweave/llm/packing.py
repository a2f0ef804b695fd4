"""Packing of documents into training windows: best-fit decreasing over a segment tree of remaining capacities.

Documents are tokenized and cut into full windows plus a remainder. The best-fit-decreasing plan depends only on how
many pieces there are of each length, so it is made from that histogram (as many rows as the capacity, whatever the
corpus): one step of the plan places a run of equal pieces into a run of equally filled windows. Each piece then
finds its place by its rank among the pieces of its length; ranks are counted in salted groups, of n pieces of a length
about the root of n groups of that size, so that a length that a third of all pieces share is still dealt over many tasks
and its groups are few enough for one.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyweave.llm.common import materialize, rows_of


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many open windows have each, and the tightest that fits."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least `need` that an open window has; -1 if there is none."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan steps (length, first_rank, n, windows, first_window, offset) of best-fit decreasing.

    The pieces of `length` with ranks first_rank..first_rank+n-1 go round and round over `windows` consecutive windows
    from first_window, each round one piece further from `offset`. That is what best fit does piece by piece: a window
    that takes a piece has become the tightest, so it takes equal pieces until the next doesn't fit.
    """
    tree, open_at, steps, opened = CapacityTree(capacity), defaultdict(deque), [], 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, new = capacity, -(-left // (capacity // length))
                open_at[room].append((opened, new))
                tree.add(room, new)
                opened += new
            first, n = open_at[room].popleft()
            each = room // length
            use = min(n, left // each)
            take = use * each
            if not use:
                use, take, each = 1, left, left
            steps.append((length, rank, take, use, first, capacity - room))
            tree.add(room, -use)
            tree.add(room - take // use * length, use)
            open_at[room - take // use * length].append((first, use))
            if n > use:
                open_at[room].appendleft((first + use, n - use))
            rank, left = rank + take, left - take
    return steps


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_path: str, ranks_path: str):
    """text -> ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    The same vocabulary as ranks gives the same ids several times as fast; texts that hold the string of a special
    token go through the tokenizer file itself.
    """
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(tokenizer_path)
    special = [str(t.content) for t in whole.get_added_tokens_decoder().values()]
    pack = lambda ids: np.array(ids, dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return pack(whole.encode(text, add_special_tokens=False).ids)
        return pack(core.encode_ordinary(text))

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Tokenize every whole text (null: empty), add `end_id`, cut into windows of `capacity` and one remainder. nth numbers a task's documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, nth = _encoder(tokenizer_path, ranks_path), int(end_id).to_bytes(4, "little"), 0
        for batch in rows_of(batches):
            out: dict[str, list] = {k: [] for k in names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, nth = encode(text or "") + end, nth + 1
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, nth, part)
                    for name, value in zip(names, row, strict=False):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary() if k == "ids" else pa.int64()) for k in names], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"] + ["ids"] * with_ids
    schema = ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def salt_of() -> Column:
    """What deals the pieces of a length over groups: their document and content, and without a doc_id their place too."""
    return F.xxhash64("doc_id", "start", "ids_crc32", F.when(F.col("doc_id").isNull(), F.col("nth")))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null text is the empty text (one token, `end_id`). Rows that share a doc_id, null ones too, are packed each on its
    own. Very long texts are read whole and cut. An empty table gives no rows. Other columns are not looked at. Pieces of equal length that tie are
    ranked by hashes, doc_id, start, ids_crc32 and doc_tokens; which of rows that agree in all these comes first doesn't matter. Rows
    without doc_id are dealt by their place in the table too, so many equal ones are no hot group.
    """
    if tokenizer_path is None or ranks_path is None:
        import public_tokenizers

        tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, ranks_path, capacity, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most one row for each length: bounded by the capacity, not by the corpus.
    salts = F.broadcast(spark.createDataFrame([(length, math.isqrt(n)) for length, n in histogram.items()], "length long, salts long"))
    salted = cut.join(salts, "length").withColumn("salt", F.pmod(salt_of(), "salts")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    steps = best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame(steps, "length long, first_rank long, n long, windows long, first_window long, step_offset long")
    # At most one row for each length, with its steps: bounded by the capacity, not by the corpus.
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "n", "windows", "first_window", "step_offset"))).alias("steps"))
    placed = ranked.join(F.broadcast(plan), "length")
    placed = placed.withColumn("step", F.filter("steps", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") < s["first_rank"] + s["n"]))[0])
    at = F.col("rank") - F.col("step.first_rank")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("step.first_window") + at % F.col("step.windows")).alias("sequence_id"),
        (F.col("step.step_offset") + F.floor(at / F.col("step.windows")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
