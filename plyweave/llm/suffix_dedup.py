"""Removal of repeated passages by a distributed, sparse suffix array.

A passage is `span` bytes. Sorting every suffix of a corpus would move each byte `span` times, so only suffixes at
anchors are moved: the anchor of a passage is the `k`-byte string in it with the smallest hash (leftmost of equals),
which equal passages have at the same place. Neighbouring passages mostly share their anchor, and one row, the anchored
suffix with the bytes around it that these passages cover, stands for all of them.

1. Each task sorts its own anchored suffixes and keeps the earliest of equal ones; a passage in a later one is a repeat.
2. Splitters range-partition what is left: a sample of suffixes, as large as there are buckets to part, is sorted in Spark
   by all k leading bytes, and every so many give one. A splitter is compared with the k leading bytes only, so suffixes
   that agree in those never fall on two sides of a boundary: what would be compared across it always differs, and no
   match is lost there.
3. Each bucket is sorted by multikey quicksort on 8-byte digits (three-way partitions; only ties go on to the next digit). Among suffixes
   that agree in their k leading bytes, equal ones again leave the earliest; the passages of those that are left are
   sorted the same way, by their place around the anchor and then their bytes. All but the earliest are repeats.
4. A bucket above a bound is not sorted but dealt anew, by hashes of more and more bytes around the anchor: a suffix is
   cut into pieces of `width` neighbouring passages at most, by their distance to the anchor, and goes by the bytes that
   all passages of such a piece have in common. Equal passages have equal such bytes, so they meet. Each task keeps the
   earliest of its equal pieces, so copies of a passage become one before they are sent; single passages come last.
5. Repeats are joined to their documents, united and cut out.

Comparisons are of bytes, never of hashes; hashes only choose anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import batch_of, materialize, rows_of

_POSITION = np.uint64((1 << 28) - 1)
_PAD = bytes(256)
#: Passages of one group of suffixes that are sorted at a time, about.
_AT_ONCE = 1 << 20
#: Bytes of suffixes, unpacked, that one task sorts as a bucket; larger buckets are dealt anew.
_BUCKET = 64 << 20
#: Most passages of a piece, round by round of dealing anew; before them whole suffixes are dealt by their k bytes.
_WIDTHS = (16, 4, 1)
#: Sampled suffixes for each splitter, fewest documents of the sample, and most buckets of the first deal: where more are wanted, each is cut by splitters of its own.
_SAMPLED, _LEAST_DOCS, _BUCKETS = 64, 2000, 1 << 16
#: Most buckets of a task.
_TASK_BUCKETS = 16
#: Segments of at most this size are sorted whole.
_SMALL = 64


def digits_of(buffer: bytes) -> np.ndarray:
    """The eight bytes from each position of `buffer` on, as a big-endian number."""
    return np.ndarray(len(buffer) - 7, dtype=">u8", buffer=buffer, strides=(1,))


def masked(digits: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The digit at `at`, with bytes beyond the `left` next ones as zero."""
    shift = (8 * np.clip(8 - left, 0, 7)).astype(np.uint64)
    return np.where(left > 0, (digits[at].astype(np.uint64) >> shift) << shift, np.uint64(0))


def partitioned(key: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The order that sorts by run, then key, equals as they come: quicksort with three-way partitions, all segments of all runs at a time.

    Runs lie together. A pass splits each segment by the median of three of its keys; what equals that is in place.
    """
    by, done = np.arange(len(key)), []
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    while len(starts):
        large = sizes > _SMALL
        done.append((starts[~large], sizes[~large]))
        starts, sizes = starts[large], sizes[large]
        if not len(starts):
            break
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(of)) - begins[of] + starts[of]
        mine = key[by[place]]
        pivot = np.sort(key[by[np.stack([starts, starts + sizes // 2, starts + sizes - 1])]], axis=0)[1][of]
        less, more = (mine < pivot).astype(np.int64), (mine > pivot).astype(np.int64)
        n_less, n_more = np.add.reduceat(less, begins), np.add.reduceat(more, begins)
        n_same, to = sizes - n_less - n_more, starts[of]
        for part, before in ((less, 0 * sizes), (1 - less - more, n_less), (more, n_less + n_same)):
            count = np.cumsum(part)
            to = to + part * (before[of] + count - 1 - (count[begins] - part[begins])[of])
        by[to] = by[place]
        starts, sizes = np.concatenate([starts, starts + n_less + n_same]), np.concatenate([n_less, n_more])
    starts, sizes = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
    of = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + starts[of]
    by[place] = by[place][np.lexsort((key[by[place]], of))]
    return by


def multikey_sort(n: int, levels: int, digit: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the n strings sorted, and for each place in that order the place where its run of equals begins.

    Multikey quicksort: digit(level, which) gives a level's digits of some strings. Strings that differ so far are
    settled; each level partitions only those that are still tied, within their ties. Equal strings keep the order of
    their numbers.
    """
    order, first, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for level in range(levels):
        if not len(tied):
            break
        key, run = digit(level, order[tied]), first[tied]
        by = partitioned(key, run)
        order[tied], key = order[tied][by], key[by]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (run[1:] != run[:-1]))))
        sizes = np.diff(np.append(new, len(tied)))
        first[tied] = np.repeat(tied[new], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
    return order, first


def _anchors(buffer: np.ndarray, span: int, k: int) -> np.ndarray:
    """The anchor's place for each place where a passage starts."""
    n, wrap = len(buffer), (1 << 64) - 1
    h, power, width = buffer.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    joined, done = None, 0
    while True:  # by binary digits of k: `h` hashes `width` bytes from each place on, `joined` the first `done`
        if k & width:
            joined = h if joined is None else joined[: len(h) - done] * np.uint64(power) + h[done:]
            done += width
        if 2 * width > k:
            break
        h = h[: len(h) - width] * np.uint64(power) + h[width:]
        power, width = power * power & wrap, 2 * width
    h = (joined ^ (joined >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    window, have = span - k + 1, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return (least[: n - span + 1] & _POSITION).astype(np.int64)


def anchored(buffer: np.ndarray, ends: np.ndarray, span: int, k: int, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, passages, anchor): runs of neighbouring passages that have the same anchor, in order of position.

    Works through `buffer` by blocks, so what it holds beside its result doesn't grow with a text's length.
    """
    found, begins = [np.zeros((3, 0), np.int64)], np.concatenate(([0], ends[:-1]))
    last = np.maximum(ends - span + 1, begins)  # beyond the last passage of each document
    for at in range(0, max(0, len(buffer) - span + 1), block):
        anchor = _anchors(buffer[at : at + block + span - 1], span, k) + at
        lo, hi = np.clip(begins, at, at + len(anchor)), np.clip(last, at, at + len(anchor))
        sizes = np.maximum(hi - lo, 0)
        places = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        if len(places):
            anchor = anchor[places - at]
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (places[1:] != places[:-1] + 1))))
            found.append(np.stack([places[new], np.diff(np.append(new, len(places))), anchor[new]]))
    return tuple(np.concatenate(found, axis=1))


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching and overlapping stretches of the same document as one."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    shift = doc_rank = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1]))) * (1 << 40)  # keeps documents apart
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate(([True], (start + doc_rank)[1:] > reach[:-1])))
    return doc[new], start[new], reach[np.append(new[1:], len(doc)) - 1] - shift[new]


def splitters_of(docs: DataFrame, n_docs: int, n_bytes: int, buckets: int, span: int, k: int, most: int | None = None) -> tuple[np.ndarray, DataFrame | None]:
    """The k leading bytes at which buckets begin, sorted, and (bucket, leads) of those within each where there are more than `most` in all.

    From about `_SAMPLED` anchored suffixes for each, of documents picked by a hash.
    """
    most = most or _BUCKETS
    within = -(-buckets // most)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            whole = b"".join(texts)
            _, _, anchor = anchored(np.frombuffer(whole, np.uint8), np.cumsum([len(t) for t in texts]), span, k)
            yield batch_of(lead=pa.array([whole[a : a + k] for a in anchor.tolist()], pa.binary()))

    share = min(1.0, max(_LEAST_DOCS / n_docs, _SAMPLED * buckets * (span - k + 1) / 2 / max(n_bytes, 1)))
    some = docs.filter(F.pmod(F.xxhash64("id", "tag"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    leads = materialize(some.mapInArrow(leading, "lead binary").groupBy("lead").agg(F.count(F.lit(1)).alias("n")), "leads")
    step = max(1, (leads.agg(F.sum("n")).first()[0] or 0) // buckets)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leads within whose suffixes, counted on, a multiple of `step` falls, and whether each is one of the first level."""
        passed, given = step // 2, 0
        for batch in batches:
            upto = passed + np.cumsum(batch.column("n").to_numpy())
            cut = batch.select(["lead"]).filter(pa.array((upto - 1) // step > (upto - batch.column("n").to_numpy() - 1) // step))
            yield batch_of(lead=cut.column("lead"), coarse=(np.arange(cut.num_rows) + given) % within == within // 2)
            passed, given = (int(upto[-1]) if len(upto) else passed), given + cut.num_rows

    # Ranges of the sample, each lead once, are sorted each by a task; of the first level no more rows than `most`, about, come to the driver.
    ranged = leads.repartitionByRange(max(1, buckets // (64 * within)), "lead").sortWithinPartitions("lead").mapInArrow(every, "lead binary, coarse boolean")
    ranged = ranged if within == 1 else materialize(ranged, "splitters")
    coarse = np.unique(np.array(ranged.filter("coarse").select("lead").toArrow().column("lead").to_pylist(), f"S{k}"))
    if within == 1:
        return coarse, None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.searchsorted(coarse, np.array(batch.column("lead").to_pylist(), f"S{k}"), side="right")
            yield batch_of(bucket=found.astype(np.int32), lead=batch.column("lead"))

    # About `within` leads a bucket.
    fine = ranged.filter("NOT coarse").mapInArrow(placed, "bucket int, lead binary").groupBy("bucket").agg(F.sort_array(F.collect_set("lead")).alias("leads"))
    return coarse, materialize(fine, "inner-splitters")


def repeated_passages(docs: DataFrame, span: int = 100, k: int = 24, bucket_bytes: int = 6 << 20, most: int = _BUCKET) -> DataFrame:
    """Stretches (id, tag, start, end, of the UTF-8 text) whose bytes lie in a passage that also starts earlier.

    id and tag name a document as `_named` does. A bucket gets the suffixes of about `bucket_bytes` of text; one with
    more than `most` bytes of suffixes is dealt anew. The result doesn't depend on how buckets are cut.
    """
    import zstandard

    sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not sizes["n"]:
        return docs.sparkSession.createDataFrame([], "id long, tag long, start long, end long")
    buckets = max(1, -(-sizes["bytes"] // bucket_bytes))
    splitters, inner = splitters_of(docs, sizes["n"], sizes["bytes"], buckets, span, k) if buckets > 1 else (np.zeros(0, f"S{k}"), None)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in rows_of(batches, 6 << 20):
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text")), strict=True), key=lambda r: r[:2])
            texts = [r[2].encode("utf-8", "surrogatepass") for r in rows]
            id_of, tag_of = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            whole = b"".join([*texts, _PAD])
            ends = np.cumsum([len(t) for t in texts])
            begin, passages, anchor = anchored(np.frombuffer(whole, np.uint8, len(whole) - len(_PAD)), ends, span, k)
            if not len(begin):
                continue
            doc = np.searchsorted(ends, begin, side="right")
            start, size, digits = begin - (ends - np.diff(ends, prepend=0))[doc], passages + span - 1, digits_of(whole)
            levels = -(-int(size.max()) // 8)
            order, first = multikey_sort(len(begin), levels + 1, lambda lv, x: masked(digits, begin[x] + 8 * lv, size[x] - 8 * lv) if lv < levels else size[x])  # noqa: B023
            kept = order[first == np.arange(len(first))]
            later = np.flatnonzero(first != np.arange(len(first)))
            this, earliest = order[later], order[first[later]]
            this = this[(id_of[doc[this]] != id_of[doc[earliest]]) | (tag_of[doc[this]] != tag_of[doc[earliest]]) | (start[this] != start[earliest])]
            d, s, e = united(doc[this], start[this], start[this] + size[this])
            yield sent(d=id_of[d], t=tag_of[d], s=s, e=e)
            leads = np.ndarray(len(whole) - k + 1, f"S{k}", whole, strides=(1,))
            bucket = np.searchsorted(splitters, leads[anchor[kept]], side="right")
            by = np.lexsort((kept, bucket))  # in order of position within a bucket: neighbours overlap, which packs best
            head = np.stack([id_of[doc], tag_of[doc], start, size, anchor - begin])
            yield sent(**packed(head, begin, whole, kept[by], bucket[by], squeeze))

    def bucketed(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        """Repeats of the buckets, each read whole; one of more than `most` comes out as it is, or is thinned if it is the last round."""
        number, blobs, held, bound, over = None, [], 0, most, False
        for batch in batches:
            for bucket, blob, *old in zip(*(batch.column(c).to_pylist() for c in ("bucket", "blob", "id", "tag", "start", "end")), strict=True):
                if blob is None:
                    yield sent(d=[old[0]], t=[old[1]], s=[old[2]], e=[old[3]])
                    continue
                if bucket != number:
                    if blobs:
                        yield sent(*repeats_in(blobs, span, k))
                    number, blobs, held, bound, over = bucket, [], 0, most, False
                blobs.append(blob)
                held += zstandard.frame_content_size(blob)
                over = over or held > bound and not last
                if over:
                    yield sent(buckets=[number] * len(blobs), blobs=blobs)
                    blobs = []
                elif held > bound:
                    yield sent(*repeats_in(blobs, span, k))
                    blobs = [thinned(blobs)]
                    held = zstandard.frame_content_size(blobs[0])
                    bound = max(most, 2 * held)
        if blobs:
            yield sent(*repeats_in(blobs, span, k))

    columns = "bucket int, blob binary, raw long, id long, tag long, start long, end long"
    shipped = docs.select("id", "tag", "text").mapInArrow(local, columns)
    # Repeats found by a task alone travel with the suffixes, spread over the buckets by their document.
    n_first = len(splitters) + 1
    placed = shipped.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(n_first)).cast("int")))
    if inner is not None:
        most_leads = inner.agg(F.max(F.size("leads"))).first()[0] or 0
        cut = placed.join(inner, "bucket", "left").mapInArrow(lambda bs: recut(bs, k, most_leads + 1), columns)
        placed, n_first = cut, n_first * (most_leads + 1)
    found, over = None, materialize(by_bucket(placed, n_first).mapInArrow(bucketed, columns), "repeats")
    for width in (span - k + 1, *_WIDTHS):
        part = over.filter(F.col("blob").isNull()).select("id", "tag", "start", "end")
        found = part if found is None else found.unionByName(part)
        over = over.filter(F.col("blob").isNotNull())
        large = over.agg(F.sum("raw")).first()[0]
        if not large:
            return found
        # Three pieces of a suffix, about, come to a round.
        n_anew = max(1, -(-12 * large // most))
        placed = over.select("blob").mapInArrow(lambda bs, w=width, n=n_anew: dealt(bs, span, w, n), columns)
        last = width == _WIDTHS[-1]
        over = materialize(by_bucket(placed, n_anew).mapInArrow(lambda bs, at_end=last: bucketed(bs, at_end), columns), "repeats")
    return found.unionByName(over.select("id", "tag", "start", "end"))


def by_bucket(placed: DataFrame, buckets: int) -> DataFrame:
    """Each bucket in one task, in order, and the buckets dealt to the tasks in turn, so that no two meet while others have none.

    As many tasks as the session has shuffle partitions, or more where these would get over _TASK_BUCKETS.
    """
    tasks = min(buckets, max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // _TASK_BUCKETS)))
    return placed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket")


def recut(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of each first-level bucket, by the splitters (`leads`) within it: bucket b becomes the buckets from b * width on."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        rest = np.flatnonzero(batch.column("blob").is_null().to_numpy(zero_copy_only=False))
        if len(rest):
            kept = batch.take(pa.array(rest))
            yield batch_of(**{c: pa.array(kept.column(c).to_numpy() * width, pa.int32()) if c == "bucket" else kept.column(c) for c in ("bucket", "blob", "raw", "id", "tag", "start", "end")})
        for bucket, blob, leads in zip(*(batch.column(c).to_pylist() for c in ("bucket", "blob", "leads")), strict=True):
            if blob is None:
                continue
            head, begin, whole = unpacked([blob])
            heads = np.ndarray(len(whole) - k + 1, f"S{k}", whole, strides=(1,))[begin + head[4]]
            at = bucket * width + np.searchsorted(np.array(leads or [], f"S{k}"), heads, side="right")
            by = np.argsort(at, kind="stable")
            yield sent(**packed(head, begin, whole, by, at[by], squeeze))


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest ones first, then all second ones: packs well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def sent(d=(), t=(), s=(), e=(), buckets=(), blobs=()) -> pa.RecordBatch:
    """Rows with stretches, or rows with packed suffixes of a bucket and their bytes unpacked."""
    import zstandard

    padded = {c: pa.concat_arrays([pa.array(np.asarray(x, np.int64)), pa.nulls(len(blobs), pa.int64())]) for c, x in (("id", d), ("tag", t), ("start", s), ("end", e))}
    bucket = pa.concat_arrays([pa.nulls(len(d), pa.int32()), pa.array(buckets, pa.int32())])
    blob = pa.concat_arrays([pa.nulls(len(d), pa.binary()), pa.array(blobs, pa.binary())])
    raw = pa.concat_arrays([pa.nulls(len(d), pa.int64()), pa.array([zstandard.frame_content_size(b) for b in blobs], pa.int64())])
    return batch_of(bucket=bucket, blob=blob, raw=raw, **padded)


def packed(head: np.ndarray, begin: np.ndarray, whole: bytes, kept: np.ndarray, bucket: np.ndarray, squeeze) -> dict:
    """Buckets and blobs, for `sent`, of the kept suffixes, which are in order of their buckets."""
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(kept) else np.zeros(1, np.int64)
    numbers, blobs = [], []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        x = kept[a:b]
        body = b"".join([whole[p : p + n] for p, n in zip(begin[x].tolist(), head[3, x].tolist(), strict=True)])
        numbers.append(int(bucket[a]))
        blobs.append(squeeze.compress(np.int64(b - a).tobytes() + b"".join(planes(h) for h in head[:, x].astype("<i8", order="C")) + body))
    return {"buckets": numbers, "blobs": blobs}


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(head, begin, whole): rows of id, tag, start, size and bytes up to the anchor, their places in `whole`, and the bytes.

    In order of document and start: ties keep the earliest first.
    """
    import zstandard

    heads, bodies = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        heads.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 40 * n, 8).reshape(5, 8, n).transpose(0, 2, 1)).view("<i8")[:, :, 0])
        bodies.append(raw[8 + 40 * n :])
    head = np.concatenate(heads, axis=1)
    whole = b"".join([*bodies, _PAD])
    begin = np.cumsum(head[3]) - head[3]
    by = np.lexsort((head[2], head[1], head[0]))
    return head[:, by], begin[by], whole


def equal_pieces(head: np.ndarray, begin: np.ndarray, whole: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of `multikey_sort`: suffixes with the same bytes and the same place of the anchor in them are equal."""
    digits, size, shape = digits_of(whole), head[3], (head[4] << 10) | head[3]
    levels = -(-int(size.max()) // 8)
    return multikey_sort(len(begin), levels + 1, lambda lv, x: masked(digits, begin[x] + 8 * lv - 8, size[x] - 8 * lv + 8) if lv else shape[x].astype(np.uint64))


def thinned(blobs: list[bytes]) -> bytes:
    """One blob with the earliest of equal suffixes; the others are repeats that `repeats_in` finds."""
    import zstandard

    head, begin, whole = unpacked(blobs)
    order, first = equal_pieces(head, begin, whole)
    kept = np.sort(order[first == np.arange(len(first))])
    return packed(head, begin, whole, kept, np.zeros(len(kept), np.int64), zstandard.ZstdCompressor(level=6))["blobs"][0]


def dealt(batches: Iterator[pa.RecordBatch], span: int, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of each blob as pieces of at most `width` passages, dealt by the bytes that a piece's passages share.

    Pieces lie on a grid of distances to the anchor: that with number c has the passages that start c * width to
    c * width + width - 1 bytes before it, which all cover the bytes from c * width before it on, for span - width + 1.
    """
    import xxhash
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            head, begin, whole = unpacked([blob])
            high = head[4]
            low = high - (head[3] - span)
            n = high // width - low // width + 1
            of = np.repeat(np.arange(len(n)), n)
            cell = (low // width)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            far, near = np.minimum(high[of], cell * width + width - 1), np.maximum(low[of], cell * width)
            skip = high[of] - far
            cut, at = np.stack([head[0, of], head[1, of], head[2, of] + skip, far - near + span, far]), begin[of] + skip
            by = np.lexsort((cut[2], cut[1], cut[0]))
            cut, at, cell = cut[:, by], at[by], cell[by]
            order, first = equal_pieces(cut, at, whole)
            later = np.flatnonzero(first != np.arange(len(first)))
            this, earliest = order[later], order[first[later]]
            this = this[(cut[:3, this] != cut[:3, earliest]).any(axis=0)]
            yield sent(*stretches(cut, this, cut[2, this], cut[2, this] + cut[3, this]))
            kept = np.sort(order[first == np.arange(len(first))])
            core = (at + cut[4] - cell * width)[kept].tolist()
            names = [xxhash.xxh64_intdigest(whole[p : p + span - width + 1], c) % buckets for p, c in zip(core, cell[kept].tolist(), strict=True)]
            bucket = np.array(names, np.int64)
            by = np.argsort(bucket, kind="stable")
            yield sent(**packed(cut, at, whole, kept[by], bucket[by], squeeze))


def stretches(head: np.ndarray, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, tag, start, end), united, of stretches of the documents that the numbers `which` in `head` (in order) are of."""
    ids, tags = head[0], head[1]
    named = np.zeros(len(ids), np.int64)
    named[1:] = np.cumsum((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))
    one = np.zeros(int(named[-1]) + 1, np.int64)
    one[named] = np.arange(len(ids))
    d, s, e = united(named[which], start, end)
    return ids[one[d]], tags[one[d]], s, e


def repeats_in(blobs: list[bytes], span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, tag, start, end) of the stretches that repeat an earlier one, among a whole bucket's anchored suffixes."""
    head, begin, whole = unpacked(blobs)
    (ids, tags, start, size, to_anchor), digits = head, digits_of(whole)
    anchor = begin + to_anchor
    order, first = multikey_sort(len(begin), -(-k // 8), lambda lv, x: masked(digits, anchor[x] + 8 * lv, k - 8 * lv + np.zeros(len(x), np.int64)))
    count = np.bincount(first, minlength=len(first))
    which, group = order[count[first] > 1], first[count[first] > 1]
    if not len(which):
        return (np.zeros(0, np.int64),) * 4
    again = np.argsort(which)
    which, group = which[again], group[again]
    levels = -(-int(size[which].max()) // 8)
    shape = (group << 20) | (to_anchor[which] << 10) | size[which]
    order, first = multikey_sort(len(which), levels + 1, lambda lv, x: masked(digits, begin[which[x]] + 8 * lv - 8, size[which[x]] - 8 * lv + 8) if lv else shape[x])
    later = np.flatnonzero(first != np.arange(len(first)))
    this, earliest = which[order[later]], which[order[first[later]]]
    this = this[(ids[this] != ids[earliest]) | (tags[this] != tags[earliest]) | (start[this] != start[earliest])]
    out = [(this, start[this], start[this] + size[this])]
    single = np.sort(order[first == np.arange(len(first))])
    which, group = which[single], group[single]
    _, inverse, n_in = np.unique(group, return_inverse=True, return_counts=True)
    which, group = which[n_in[inverse] > 1], group[n_in[inverse] > 1]
    # Passages of suffixes with the same leading bytes, by how far before the anchor they start.
    passages = size[which] - span + 1
    high, low = to_anchor[which], to_anchor[which] - passages + 1
    for offset in range(span - k + 1) if passages.sum() > _AT_ONCE else (None,):
        if offset is None:
            of = np.repeat(np.arange(len(which)), passages)
            step = np.arange(len(of)) - np.repeat(np.cumsum(passages) - passages, passages)
        else:
            of = np.flatnonzero((low <= offset) & (offset <= high))
            step = high[of] - offset
        if len(of) < 2:
            continue
        at, key = begin[which[of]] + step, (group[of] << 10) | (high[of] - step)
        full = span // 8
        ends_in = [x for pair in zip(range(full), reversed(range(full)), strict=True) for x in pair][:full]
        turns = [8 * t for t in dict.fromkeys(ends_in)] + ([span - 8] if span % 8 else [])
        order, first = multikey_sort(len(of), len(turns) + 1, lambda lv, x: digits[at[x] + turns[lv - 1]].astype(np.uint64) if lv else key[x].astype(np.uint64))  # noqa: B023
        later = np.flatnonzero(first != np.arange(len(first)))
        this, earliest = order[later], order[first[later]]
        doc, was = which[of[this]], which[of[earliest]]
        real = (ids[doc] != ids[was]) | (tags[doc] != tags[was]) | (start[doc] + step[this] != start[was] + step[earliest])
        doc, s = doc[real], start[doc[real]] + step[this[real]]
        out.append((doc, s, s + span))
    docs, s, e = (np.concatenate([o[i] for o in out]) for i in range(3))
    return stretches(head, docs, s, e)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what names a document: id (null doc_ids last) and tag, which tells apart texts that share an id."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    repeated = plain.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    return plain.withColumn("tag", F.xxhash64("text") if repeated > 1 else F.lit(0).cast("long"))


def remove_repeats(docs: DataFrame, span: int = 100, k: int = 24) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, spans (array of start, end: maximal removed runs), kept (binary).

    A byte goes if a string of `span` bytes that covers it also starts earlier: in a smaller doc_id, or in the same text
    at a smaller start, overlaps included; strings are judged on the input. Null texts are empty. Null doc_ids come after
    all others. Rows that share doc_id and text are one document and give equal rows; rows that share the doc_id only are
    documents in the order of a hash of their texts. Very long texts are read whole, in blocks. An empty table gives no
    rows. Other columns are not looked at, whatever their names.
    """
    named = _named(docs)
    found = repeated_passages(named, span, k)
    per_doc = found.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for batch in rows_of(batches):
            packed = [small.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield batch_of(**{c: batch.column(c) for c in ("doc_id", "id", "tag")}, packed=pa.array(packed, pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        large = zstandard.ZstdDecompressor()
        for batch in rows_of(batches):
            n_bytes, n_removed, spans, kept = [], [], [], []
            for packed, stretches in zip(batch.column("packed").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data, runs = large.decompress(packed), []
                if stretches:
                    s, e = (np.array([x[c] for x in stretches], np.int64) for c in ("start", "end"))
                    _, s, e = united(np.zeros(len(s), np.int64), s, e)
                    runs = list(zip(s.tolist(), e.tolist(), strict=True))
                n_bytes.append(len(data))
                n_removed.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)], strict=True)))
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            numbers = {"n_bytes": np.array(n_bytes, np.int64), "n_removed": np.array(n_removed, np.int64)}
            yield batch_of(doc_id=batch.column("doc_id"), **numbers, spans=pa.array(spans, pairs), kept=pa.array(kept, pa.binary()))

    # Texts go to the join packed: Spark's own shuffle compression sees too little of one text to do as well.
    packed = named.mapInArrow(squeeze, "doc_id long, id long, tag long, packed binary")
    joined = packed.join(per_doc, ["id", "tag"], "left").select("doc_id", "packed", "found")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns of `remove_repeats`' rows."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: `digest` of `remove_repeats` over documents with distinct doc_ids. Every 100-byte string is a row here, so it is for small tables.
ORACLE_SQL = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, p, substring(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM doc)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM starts) WHERE n > 1),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r
        FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM later))
  GROUP BY doc_id, r),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS final,
         string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) JOIN doc USING (doc_id)
  GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substring(h, 2 * final + 1) END)) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""
