"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; documents link at `radius` or fewer differing bits. Each bit gets a nonzero vector of
radius + 1 binary digits, and each nonzero vector v is a table whose mask keeps the bits whose vector has an odd
product with v. At most `radius` differing bits have vectors that some v is orthogonal to, so in that table both
fingerprints look the same: every pair within the radius collides somewhere, with certainty.

Copies are merged before any table is made. A table's bucket yields the edges of a spanning forest of its links, not
its pairs; one that is too large for a task is dealt anew by a covering family over the bits its table left free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import materialize, rows_of
from plyweave.llm.components import connected_components

#: Distinct fingerprints of a bucket that one task compares; larger buckets are dealt anew.
BUCKET = 16_384


def text_fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if more than half of the shingles' XXH64 values have it."""
    import xxhash

    plain = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(plain)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= words:
        return digest(plain, seed)
    values = np.array([digest(plain[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 65_536):
        ones += np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), fp (the 64 bits as a signed long) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fps = np.array([text_fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(fps)], names=["doc_id", "tag", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, tag long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """The masks, as signed longs, of a covering family over the given bit positions."""
    vectors = (1 << radius + 1) - 1
    of = {bit: 1 + i % vectors for i, bit in enumerate(bits)}
    masks = [sum(1 << bit for bit, m in of.items() if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (positions in `fps`) that connect what chains of links connect, at most len(fps) - 1 of them."""
    edges, rest = [], np.arange(len(fps))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            new, rest = rest[near].tolist(), rest[~near]
            edges += [(at, x) for x in new]
            todo += new
    return edges


def links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b: representatives) that connect the distinct fingerprints (fp, rep) that chains of links connect.

    A bucket is a table and the bits that its mask keeps, named by their hash; buckets whose names clash are compared
    as one, which costs time only. `path` lists the tables that led to a bucket as digits.
    """
    base, found = 1 << radius + 1, None
    todo = prints.select("fp", "rep", F.lit(0).cast("long").alias("within"), F.lit(0).cast("long").alias("path"))
    paths = [0]
    while paths:
        masks = {p: covering_masks(free_bits(p, radius), radius) for p in paths}
        tables = F.create_map(*[x for p, ms in masks.items() for x in (F.lit(p).cast("long"), F.array(*[F.struct(F.lit(p * base + v).cast("long").alias("path"), F.lit(m).cast("long").alias("mask")) for v, m in enumerate(ms, 1)]))])
        dealt = todo.select("fp", "rep", "within", F.explode(tables[F.col("path")]).alias("t"))
        dealt = dealt.select(F.xxhash64("within", "t.path", F.expr("fp & t.mask")).alias("bucket"), F.col("t.path").alias("path"), "fp", "rep")
        last = all(len(free_bits(m * base + 1, radius)) < max(bucket, BUCKET).bit_length() for m in masks)  # can't be larger

        def run(batches: Iterator[pa.RecordBatch], most: int = 1 << 62 if last else bucket) -> Iterator[pa.RecordBatch]:
            """Edges of the buckets, each read whole; rows of a bucket of more than `most` come out as they are."""
            rest, over = None, None  # the rows of the bucket that is being read; the last bucket that was too large
            for batch in batches:
                rows = np.stack([batch.column(c).to_numpy() for c in ("bucket", "path", "fp", "rep")])
                rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
                if not rows.shape[1]:
                    continue
                starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
                sizes = np.diff(np.append(starts, rows.shape[1]))
                large = (sizes > most) | (rows[0, starts] == over if over is not None else False)
                if large.any():
                    yield given(rows[:, np.repeat(large, sizes)])
                over = rows[0, -1] if large[-1] else None
                open_run = np.arange(len(starts)) == len(starts) - 1
                rest = None if large[-1] else rows[:, starts[-1] :]
                ready = ~large & ~open_run & (sizes > 1)
                if ready.any():
                    yield joined(rows[:, np.repeat(ready, sizes)], sizes[ready])
            if rest is not None and rest.shape[1] > 1:
                yield joined(rest, np.array([rest.shape[1]]))

        def given(rows: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(rows.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), none, none], names=names)

        def joined(rows: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            fp, rep, starts = np.ascontiguousarray(rows[2]).view(np.uint64), rows[3], np.cumsum(sizes) - sizes
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            ends = [np.stack([rep[two], rep[two + 1]])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if got := forest(fp[s : s + n], radius):
                    ends.append(rep[np.array(got).T + s])
            pair = np.sort(np.concatenate(ends, axis=1), axis=0)
            none = pa.nulls(pair.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.array(p) for p in pair], names=names)

        names = ["bucket", "path", "fp", "rep", "a", "b"]
        out = materialize(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ", ".join(f"{n} long" for n in names)), "links")
        edges, over = out.filter(F.col("a").isNotNull()).select("a", "b"), out.filter(F.col("a").isNull())
        found = edges if found is None else found.unionByName(edges)
        paths = sorted(r["path"] for r in over.select("path").distinct().collect())  # as many as there are tables, at most
        todo = over.select("fp", "rep", F.col("bucket").alias("within"), "path")
    return found.distinct()


def free_bits(path: int, radius: int) -> list[int]:
    """Bits that none of the path's tables looks at: those in which members of its bucket may differ."""
    if not path:
        return list(range(64))
    bits = free_bits(path >> radius + 1, radius)
    mask = covering_masks(bits, radius)[(path & (1 << radius + 1) - 1) - 1]
    return [b for b in bits if not (mask & (1 << 64) - 1) >> b & 1]


def near_duplicates(docs: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per row of `docs`: doc_id, tag (hash of the text), fp (long), fingerprint (16 hex digits), component_id, component.

    component_id is the smallest doc_id that chains of links reach, the row's own included. Null, empty and blank texts
    have fingerprint zero and link like any other. Texts of fewer words than a shingle are one shingle. Rows that share
    a doc_id each give a row and link by each one's text. A row whose doc_id is null gets its own fingerprint and its
    component's smallest non-null doc_id, null if there is none. Components that share a repeated doc_id may have the same
    component_id; component, a fingerprint of each, tells them apart. A bit that exactly half of the shingles have is 0. Very
    long texts are read whole. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # A doc_id that stands on several rows joins their fingerprints, so each fingerprint needs a node of its own: itself.
    nodes = materialize(by_print.select("fp", F.col("fp").alias("rep"), F.col("rep").alias("least")), "distinct-fingerprints")
    parts = connected_components(links(nodes.select("fp", "rep"), radius, bucket))
    named = nodes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "least", F.coalesce("component", "rep").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(smallest, "component").select("fp", "component_id", "component")
    return prints.join(of_print, "fp").select("doc_id", "tag", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of `docs`, unchanged, that stand for their component: that with the smallest doc_id.

    If that doc_id has several rows in the component, the text with the smallest hash stays, and of rows that share both
    that whose columns, written as JSON, have the smallest hash. Far texts that share a doc_id are of different
    components, each of which keeps its row. Rows without doc_id all stay, as nothing names them.
    """
    found = near_duplicates(docs, radius).filter(F.col("doc_id").isNotNull()).groupBy("component", "doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "tag", "n")).alias("least"))
    first = materialize(first.select(F.col("least.doc_id").alias("kept_id"), F.col("least.tag").alias("kept_tag"), F.col("least.n").alias("kept_n")), "kept")
    tag = F.xxhash64(docs["text"].cast("string"))
    of = lambda which: docs.join(first.filter(which), (docs["doc_id"].cast("long") == first["kept_id"]) & (tag == first["kept_tag"]), "left_semi")
    kept = of("kept_n = 1").unionByName(docs.filter(F.col("doc_id").isNull()))
    if first.filter("kept_n > 1").isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = of("kept_n > 1").select(F.col("doc_id").alias("kept_id"), F.xxhash64(F.col("text").cast("string")).alias("kept_tag"), row.alias("row"))
    several = several.groupBy("kept_id", "kept_tag").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.unionByName(several.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
