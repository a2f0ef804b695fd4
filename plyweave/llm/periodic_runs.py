"""Detection of periodic runs: stretches of words that repeat with a period, and texts with each run cut to one period.

How far two places of a document agree (their longest common extension) is answered by a difference cover: of every
`PERIOD` neighbouring places those whose residues are in `COVER` are samples, and any two places reach two samples after
the same few words, fewer than `PERIOD`.

1. Only suffixes that start at samples are sorted: by document, then two words at a time, where ties are left, up to the
   cover's period; then by doubling, the rank of the sample one, two, four ... periods on.
2. The common prefix of neighbours in that order goes into a sparse table of range minima.
3. An extension compares words up to the samples and then asks the table. The reversed words give extensions backwards.

Runs are enumerated on harmonic grids: a run of period q and of `exponent` periods or more has a stretch of matches
(words equal to the one q later) at least `exponent - 1` periods long, so one of the grid places 0, s, 2s, ... with s of
that length is in it. Each grid place that matches is extended both ways, and stretches of at least s are runs. The grids
of all periods together have about n ln n / 3 places.

A task does this for a batch of documents at once: they stand in one array, a zero between them. Documents are independent,
so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import rows_of

# A perfect difference set. Each residue but zero is the difference of exactly one pair.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: For each difference of two places, the residue to which the first has to move; for zero any will do.
_MEETS = np.array([next(x for x in COVER if (x + d) % PERIOD in COVER) for d in range(PERIOD)])
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Grid places that a task looks at together.
_PLACES = 1 << 20


def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order the tied samples further by `key`, in place; those that still are tied. A rank is the number of samples before its class."""
    order = np.lexsort((key, rank[tied]))
    tied, key = tied[order], key[order]
    old = rank[tied]
    first = np.ones(len(tied), bool)
    first[1:] = old[1:] != old[:-1]
    at = np.arange(len(tied))
    begin = np.maximum.accumulate(np.where(first, at, 0))
    first[1:] |= key[1:] != key[:-1]
    rank[tied] = old + np.maximum.accumulate(np.where(first, at, 0)) - begin
    last = np.append(first[1:], True)
    return tied[~(first & last)]


class Extensions:
    """How many words two places of one document have in common from there on.

    `words` are numbers from 1, with a zero before, between and after documents; `doc` is each place's document, rising.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray) -> None:
        self.words = np.concatenate([words, np.zeros(PERIOD + 1, words.dtype)])
        size = len(words)
        at = np.flatnonzero(_IN_COVER[np.arange(size) % PERIOD] & (words != 0))
        self.sample = np.full(size + PERIOD + 1, -1, np.int64)
        self.sample[at] = np.arange(len(at))
        _, begin, which = np.unique(doc[at], return_index=True, return_inverse=True)
        levels = self._sort(at, begin[which].astype(np.int64))
        self.rank = levels[-1]
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        self._table(self._neighbours(at[order], doc[at][order], levels), np.diff(np.append(begin, len(at))).max(initial=1))

    def _sort(self, at: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
        """Ranks of the samples by their first 1, 2, 4 ... periods, until all differ."""
        tied = _refine(rank, np.arange(len(at)), np.zeros(len(at), np.int64))
        for t in range(0, PERIOD, 2):
            place = at[tied] + t
            tied = _refine(rank, tied, (self.words[place] << 32) | self.words[place + 1])
        levels = [rank]
        while len(tied):
            place, rank = at[tied] + (PERIOD << (len(levels) - 1)), rank.copy()
            # Of tied samples none has left its document; one that has come to its end is smaller than all others.
            beyond = self.sample[np.minimum(place, len(self.sample) - 1)]
            tied = _refine(rank, tied, np.where(beyond < 0, -1, levels[-1][beyond]))
            levels.append(rank)
        return levels

    def _neighbours(self, place: np.ndarray, doc: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words in common of each sampled suffix with the next in order; zero across documents."""
        same = np.flatnonzero(doc[1:] == doc[:-1])
        a, b = place[:-1][same], place[1:][same]
        off = np.zeros(len(same), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x = self.sample[np.minimum(a + off, len(self.sample) - 1)]
            y = self.sample[np.minimum(b + off, len(self.sample) - 1)]
            off += np.where((x >= 0) & (y >= 0) & (levels[k][x] == levels[k][y]), PERIOD << k, 0)
        live = np.arange(len(same))
        while len(live):
            x, y = self.words[a[live] + off[live]], self.words[b[live] + off[live]]
            live = live[(x == y) & (x != 0)]
            off[live] += 1
        common = np.zeros(max(len(place) - 1, 0), np.int32)
        common[same] = off
        return common

    def _table(self, common: np.ndarray, longest: int) -> None:
        """Range minima: row k has the least of 2^k neighbours. Ranges never leave a document."""
        rows = [common]
        for k in range(int(longest).bit_length() - 1):
            last = rows[-1]
            row = last.copy()
            row[: max(len(last) - (1 << k), 0)] = np.minimum(last[: max(len(last) - (1 << k), 0)], last[1 << k :])
            rows.append(row)
        self.least = np.stack(rows)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places of a document (or the zero beside it)."""
        out = np.zeros(len(i), np.int64)
        ahead = (_MEETS[(j - i) % PERIOD] - i) % PERIOD
        live, met, t = np.arange(len(i)), [], 0
        while len(live):
            there = ahead[live] == t
            met.append(live[there])
            live = live[~there]
            x = self.words[i[live] + t]
            same = (x == self.words[j[live] + t]) & (x != 0)
            out[live[~same]] = t
            live, t = live[same], t + 1
        met = np.concatenate([np.zeros(0, np.int64), *met])
        out[met] = ahead[met]
        a, b = self.sample[i[met] + ahead[met]], self.sample[j[met] + ahead[met]]
        inside = (a >= 0) & (b >= 0)  # else one is at the end
        met, a, b = met[inside], self.rank[a[inside]], self.rank[b[inside]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out[met] += np.minimum(self.least[k, low], self.least[k, high - (1 << k)])
        return out


def runs_in(words: np.ndarray, begin: np.ndarray, count: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period; start and end are places in `words`.

    `words`: documents with a zero before each and one after the last; they begin at `begin` and have `count` words.
    """
    doc = np.repeat(np.arange(len(begin) + 1), np.append(count + 1, 1))
    size, found = len(words), [np.zeros((3, 0), np.int64)]
    ahead, back = Extensions(words, doc), Extensions(words[::-1].copy(), (len(begin) - doc)[::-1].copy())
    periods = np.where(count >= shortest, count // exponent, 0)
    owner = np.repeat(np.arange(len(begin)), periods)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(shortest, exponent * q) - q
    places = -((q - count[owner]) // step)
    total = np.cumsum(places)
    at = 0
    while at < len(q):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PLACES, "right")))
        n, which = places[at:end], np.repeat(np.arange(at, end), places[at:end])
        i = begin[owner[which]] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * step[which]
        j = i + q[which]
        match = words[i] == words[j]
        i, j, which = i[match], j[match], which[match]
        after, before = ahead(i, j), back(size - i, size - j)
        run = after + before >= step[which]
        found.append(np.stack([(i - before)[run], (j + after)[run], q[which][run]]))
        found[-1] = found[-1][:, np.lexsort(found[-1][[2, 1, 0]])]
        found[-1] = found[-1][:, _first_of(found[-1][:2])]
        at = end
    runs = np.concatenate(found, axis=1)
    # A stretch with a period has the multiples of that period too: its smallest counts.
    runs = runs[:, np.lexsort(runs[[2, 1, 0]])]
    runs = runs[:, _first_of(runs[:2])]
    return tuple(runs[:, np.lexsort(runs[[2, 0]])])


def _first_of(rows: np.ndarray) -> np.ndarray:
    """Which columns of sorted rows differ from the one before."""
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    return first


def _batch(ids: pa.Array, texts: pa.Array, exponent: int, shortest: int) -> pa.RecordBatch:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    edge = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    flat = lists.flatten()
    there = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    edge = np.append(0, np.cumsum(there))[edge]
    flat, count = flat.filter(pa.array(there)), np.diff(edge)
    begin = edge[:-1] + np.arange(len(count)) + 1
    place = np.arange(len(flat)) + np.repeat(np.arange(len(count)), count) + 1
    words = np.zeros(len(flat) + len(count) + 1, np.int64)
    words[place] = np.asarray(flat.dictionary_encode().indices).astype(np.int64) + 1
    start, end, period = runs_in(words, begin, count, exponent, shortest)
    # Words of a run after its first period go.
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone)[place] == 0
    left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept))[edge].astype(np.int32)), flat.filter(pa.array(kept)))
    owner = np.searchsorted(begin, start, "right") - 1
    each = np.searchsorted(owner, np.arange(len(count) + 1)).astype(np.int32)
    run = pa.StructArray.from_arrays([pa.array(start - begin[owner]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays([ids, pa.array(count), pa.ListArray.from_arrays(pa.array(each), run), pc.binary_join(left, " ")], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period) and the collapsed text of every row.

    Words are what white space (ASCII) separates, compared by bytes, numbered from 0. A run has at least `exponent`
    (2 or more) times its smallest period and at least `shortest` words, and no neighbouring word continues it. Words of a
    run after its first period are left out of the collapsed text, whose words are joined by one space. Null and empty
    texts have no words, no runs and an empty collapsed text. Rows that repeat or have no doc_id are judged each by
    itself. A text is held whole by one task, with about 200 bytes a word. Other columns are not looked at. An empty table
    gives no rows.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield _batch(batch.column("doc_id"), batch.column("text"), exponent, shortest)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by its hash ends in a passage of its own that repeats.

    With h = crc32(doc_id) and g = h div 10, documents with h % 10 = 0 and n words keep g % n words, and the
    1 + (n - g % n) div (3 + g % 8) words after these repeat to the same number of words. Rows without doc_id stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    chosen = F.col("h") % 10 == 0
    rows = rows.withColumn("words", F.when(chosen, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    n = F.size("words").cast("long")
    rows = rows.withColumn("n", F.when(chosen, n).otherwise(0)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    whole = lambda c: F.col(c).cast("int")
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", whole("a") + 1, whole("p")), times)), F.lit(1), whole("n") - whole("a"))
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), whole("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest exponent; hashes of all runs and of the collapsed text."""
    # Runs are by start, then period, so that the first of equals stays.
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", most)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Runs by all pairs of equal words: neighbouring pairs with one distance are a stretch of matches. crc32 is worked out bit by bit.
ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h
  FROM documents),
sized AS (SELECT doc_id, len(ws) AS n, h % 10 = 0 AS chosen, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS p FROM doc WHERE len(ws) > 0),
was AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM doc),
wanted AS (SELECT doc_id, n, i, CASE WHEN chosen AND i >= a THEN a + (i - a) % p ELSE i END AS src FROM was JOIN sized USING (doc_id)),
word AS (SELECT t.doc_id, n, t.i, w FROM wanted t JOIN was ON t.doc_id = was.doc_id AND t.src = was.i),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
