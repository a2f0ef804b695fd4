"""Proof that a copy is right: counts, checksums, fingerprints, differences by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyweave.sources.tables import predicate


def validate_counts(source: DataFrame, target: DataFrame, where: str | None = None) -> DataFrame:
    """source_rows (filtered), target_rows (all: it should hold only filtered rows), is_match. Two scalar counts."""
    a = source.filter(predicate(where)).agg(F.count(F.lit(1)).alias("source_rows"))
    b = target.agg(F.count(F.lit(1)).alias("target_rows"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").select("source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("is_match"))


def require_counts(source: DataFrame, target: DataFrame, where: str | None = None) -> None:
    """Raise ValueError with both numbers if the counts differ."""
    row = validate_counts(source, target, where).first()
    if not row["is_match"]:
        raise ValueError(f"row counts differ: {row['source_rows']} in the source, {row['target_rows']} in the target")


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


def _flat(f: T.StructField) -> Column:
    """The column; a nested one as JSON with its nulls, map entries in order."""
    c = F.col(f"`{f.name}`")
    c = F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c
    return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})) if _nested(f.dataType) else c


def _as_text(f: T.StructField, scale: int | None) -> Column:
    """The value with all its digits, its length before it; a null is '-', so no two different rows read alike."""
    c = _flat(f)
    if isinstance(f.dataType, T.FloatType | T.DoubleType) and scale is not None:
        c = c.cast(T.DecimalType(38, scale))
    c = F.hex(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def row_checksums(df: DataFrame, keys: list[str], exclude: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """keys and md5 of each row's columns as text, each with its length before it, null as '-'.

    Times and doubles have all their digits; `scale` rounds doubles to so many decimals, for engines that print them otherwise.
    `exclude` leaves out wide text columns.
    """
    used = [f for f in df.schema if f.name not in (exclude or [])]
    return df.select(*keys, F.md5(F.concat(F.lit(""), *[_as_text(f, scale) for f in used])).alias("checksum"))


def content_hash(df: DataFrame, exclude: list[str] | None = None) -> Column:
    """A 64-bit hash of a row's typed values; which columns are null is hashed too, as a hash of values alone skips nulls."""
    used = [f for f in df.schema if f.name not in (exclude or [])]
    return F.xxhash64(F.lit(len(used)), *[x for f in used for x in (_flat(f), F.col(f"`{f.name}`").isNull())])


def content_sum(hashed: Column) -> Column:
    """An aggregate that is equal for equal rows in any order: sums of three parts of their hashes, which 2^41 rows can't overflow."""
    return F.concat_ws(":", *[F.sum(part).cast("string") for part in _parts(hashed)])


def _parts(hashed: Column) -> list[Column]:
    return [F.shiftrightunsigned(hashed, bits).bitwiseAND(F.lit((1 << 22) - 1)) for bits in (0, 22, 44)]


def checksum_mismatches(source: DataFrame, target: DataFrame, keys: list[str], exclude: list[str] | None = None) -> DataFrame:
    """One row: n_changed (same key, other checksum), n_only_source, n_only_target."""
    a, b = row_checksums(source, keys, exclude), row_checksums(target, keys, exclude).withColumnRenamed("checksum", "other")
    joined = a.join(b, keys, "full")
    return joined.agg(
        F.count_if(F.col("checksum") != F.col("other")).alias("n_changed"),
        F.count_if(F.col("other").isNull()).alias("n_only_source"),
        F.count_if(F.col("checksum").isNull()).alias("n_only_target"),
    )


def table_fingerprint(df: DataFrame, key: str, chunk: int, exclude: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """chunk (of `chunk` keys; null keys are one), n_rows, fingerprint (sum of the first 60 bits of row checksums, as text): equal for equal content in any order."""
    value = F.conv(F.substring("checksum", 1, 15), 16, 10).cast("decimal(20,0)")
    summed = row_checksums(df, [key], exclude, scale).groupBy(F.floor(F.col(key) / chunk).alias("chunk"))
    return summed.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).cast("string").alias("fingerprint"))


def row_diff(source: DataFrame, target: DataFrame, keys: list[str], most: int | None = 100) -> DataFrame:
    """Rows with the same key and other values: keys, differing columns, both sides' differing values as text.

    Comparison is null-safe. The first `most` by key (None: all). Without other columns than keys there are no rows.
    """
    rest = [c for c in source.columns if c not in keys]
    if not rest:
        return source.select(*keys, F.array().cast("array<string>").alias("columns"), F.create_map().cast("map<string,string>").alias("source_values"), F.create_map().cast("map<string,string>").alias("target_values")).limit(0)
    joined = source.alias("s").join(target.alias("t"), [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys], "inner")
    differs = {c: ~F.col(f"s.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in rest}
    columns = F.array_compact(F.array(*[F.when(d, c) for c, d in differs.items()]))
    values = lambda side: F.map_from_arrays(F.col("columns"), F.transform("columns", lambda c: F.create_map(*[x for n in rest for x in (F.lit(n), F.col(f"{side}.`{n}`").cast("string"))])[c]))
    found = joined.withColumn("columns", columns).filter(F.size("columns") > 0)
    found = found.select(*[F.col(f"s.{k}").alias(k) for k in keys], "columns", values("s").alias("source_values"), values("t").alias("target_values"))
    return found if most is None else found.orderBy(*keys).limit(most)


def reconcile(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status (only_source, only_target, changed, same) of every key of either table."""
    rest = [c for c in source.columns if c not in keys]
    slim = lambda df, name: df.select(*keys, F.struct(F.lit(1).alias("here"), *[F.col(f"`{c}`") for c in rest]).alias(name))
    joined = slim(source, "_s").join(slim(target.select(source.columns), "_t"), keys, "full")
    status = F.when(F.col("_t").isNull(), "only_source").when(F.col("_s").isNull(), "only_target").when(~F.col("_s").eqNullSafe(F.col("_t")), "changed").otherwise("same")
    return joined.select(*keys, status.alias("status"))


def reconcile_summary(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """status, n_keys."""
    return reconcile(source, target, keys).groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"))


def _whole(df: DataFrame, chunk_key: str | None) -> bool:
    return chunk_key is not None and isinstance(df.schema[chunk_key].dataType, T.IntegralType)


def _place(df: DataFrame, keys: list[str], chunk_key: str | None) -> Column:
    """A number by which rows are put into ranges: a whole-number column itself, else a hash of the column or of the keys."""
    if _whole(df, chunk_key):
        return F.col(chunk_key).cast("long")
    columns = keys if chunk_key is None else [chunk_key]
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def _chunk(place: Column, size: int) -> Column:
    """The number of the range of `size` places that holds the place, rounded down in whole numbers: all 64 bits count."""
    if size & (size - 1) == 0:
        return F.shiftright(place, size.bit_length() - 1)
    return F.call_function("div", place, F.lit(size)) - F.when(place % F.lit(size) < 0, 1).otherwise(0)


def _intervals(chunks: list[int], size: int) -> list[tuple[int, int]]:
    """[low, high) of the places of the chunks, neighbours put together."""
    out: list[tuple[int, int]] = []
    for c in sorted(chunks):
        if out and out[-1][1] == c * size:
            out[-1] = (out[-1][0], (c + 1) * size)
        else:
            out.append((c * size, (c + 1) * size))
    return out


#: Ranges of a level that come to the driver to narrow the next one, of these those that are looked up in a list, and intervals that are written as a predicate.
MOST_BROADCAST, MOST_RANGES, MOST_INTERVALS = 1_000_000, 10_000, 200
#: Ranges of the first level of hashes have this size, so there are 1,024; the finest ones have about so many rows, however large the table.
FIRST_HASHES, RANGE_ROWS = 1 << 54, 1


def _compared(source: DataFrame, target: DataFrame, keys: list[str], chunk_key: str | None, size: int, even: bool = False) -> DataFrame:
    """_chunk, n_rows (of both), odd (whether the content differs), by one shuffle: the target's rows are subtracted from the source's.

    `even`: ranges have few rows each, so tasks send hashes as they are; sums by task would fill memory and merge hardly any.
    """
    signed = []
    for df, sign in ((source, 1), (target.select(source.columns), -1)):
        signed.append(df.select(_chunk(_place(df, keys, chunk_key), size).cast("long").alias("_chunk"), F.lit(sign).cast("long").alias("sign"), content_hash(df).alias("h")))
    both = signed[0].unionAll(signed[1])
    both = both.repartition("_chunk") if even else both
    left = {"sign": F.col("sign")} | {f"h{i}": F.col("sign") * part for i, part in enumerate(_parts(F.col("h")))}
    summed = both.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(name) for name, c in left.items()])
    return summed.select("_chunk", "n_rows", F.greatest(*[F.col(name) != 0 for name in left]).alias("odd"))


def _finest(n: int) -> int:
    """The size at which hashes of n rows are in ranges of about RANGE_ROWS rows."""
    return 1 << max(0, 64 - max(0, n // RANGE_ROWS - 1).bit_length())


def differing_rows(source: DataFrame, target: DataFrame, keys: list[str], chunk_key: str | None = None, sizes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both in ranges whose content differs, and all whose keys are null in part.

    Ranges are of `chunk_key`, if it is of whole numbers, else of a hash of it, or of the keys (any number of any type). `sizes`
    falls: the sums of the largest ranges are compared first, then those of the next size within ranges that differ. Without
    `sizes` hashes have two levels, the second of ranges that hold about RANGE_ROWS rows: what is read for a row that differs doesn't
    grow with the table. Rows with a null `chunk_key` are a range of their own.
    Ranges that differ come to the driver up to MOST_BROADCAST; where there are more, both tables are shuffled to be joined with them, and nothing finer is tried.
    At each level both tables are read, filtered by intervals of the key, which reaches the scan if these are few.
    """
    whole = _whole(source, chunk_key)
    fitted = sizes is None and not whole
    sizes = list(sizes or ([FIRST_HASHES] if fitted else [1 << 54, 1 << 44]))
    even = False
    narrow: Callable[[DataFrame], DataFrame] = lambda df: df
    odd_keys = F.lit(False)
    for k in keys:
        odd_keys = odd_keys | F.col(k).isNull()
    for level, size in enumerate(sizes):
        compared = _compared(narrow(source), narrow(target), keys, chunk_key, size, even)
        odd = compared.filter("odd").select("_chunk")
        if fitted and level == 0:
            rows = compared.collect()  # one for each of the 1,024 ranges
            found = [r["_chunk"] for r in rows if r["odd"]]
            n = sum(r["n_rows"] for r in rows)
            # A hash that many rows have (a repeated key, a column of few values) makes its range stand out.
            even = max((r["n_rows"] for r in rows), default=0) * ((1 << 64) // size) <= 4 * n
            sizes += [_finest(n // 2)] if _finest(n // 2) < size else []
        else:
            few = odd.limit(MOST_BROADCAST + 1).toArrow()
            if few.num_rows > MOST_BROADCAST:
                narrow = _joined(odd, keys, chunk_key, size, odd_keys)
                break
            if few.num_rows > MOST_RANGES:
                narrow = _joined(F.broadcast(source.sparkSession.createDataFrame(few, "_chunk long")), keys, chunk_key, size, odd_keys)
                continue
            found = few["_chunk"].to_pylist()
        if not found:
            return source.filter(odd_keys), target.filter(odd_keys)
        spans, nulls = _intervals([c for c in found if c is not None], size), None in found
        if not whole:
            narrow = _among(found, keys, chunk_key, size, odd_keys)
        elif len(spans) <= MOST_INTERVALS:
            narrow = _between(spans, nulls, keys, chunk_key, odd_keys)
        else:
            # At most MOST_RANGES rows.
            few = source.sparkSession.createDataFrame([(c,) for c in found], "_chunk long")
            narrow = _joined(F.broadcast(few), keys, chunk_key, size, odd_keys)
    return narrow(source), narrow(target)


def _between(spans: list[tuple[int, int]], nulls: bool, keys: list[str], chunk_key: str | None, odd_keys: Column) -> Callable[[DataFrame], DataFrame]:
    def narrow(df: DataFrame) -> DataFrame:
        place, wanted = _place(df, keys, chunk_key), odd_keys
        if nulls:
            wanted = wanted | F.col(chunk_key).isNull()
        for low, high in spans:
            inside = place >= F.lit(max(low, -(1 << 63)))
            wanted = wanted | (inside if high >= 1 << 63 else inside & (place < F.lit(high)))
        return df.filter(wanted)

    return narrow


def _among(found: list[int], keys: list[str], chunk_key: str | None, size: int, odd_keys: Column) -> Callable[[DataFrame], DataFrame]:
    """By hashes, which reach no scan: one look-up among at most MOST_RANGES numbers, so that a row is hashed once."""
    return lambda df: df.filter(odd_keys | _chunk(_place(df, keys, chunk_key), size).isin(found))


def _joined(chunks: DataFrame, keys: list[str], chunk_key: str | None, size: int, odd_keys: Column) -> Callable[[DataFrame], DataFrame]:
    def narrow(df: DataFrame) -> DataFrame:
        inside = df.filter(~odd_keys).withColumn("_at", _chunk(_place(df, keys, chunk_key), size).cast("long"))
        same = F.col("_at") == F.col("_chunk") if not _whole(df, chunk_key) else F.col("_at").eqNullSafe(F.col("_chunk"))
        inside = inside.join(chunks, same, "left_semi").drop("_at")
        return inside.unionByName(df.filter(odd_keys))

    return narrow


def reconcile_by_ranges(source: DataFrame, target: DataFrame, keys: list[str], chunk_key: str | None = None, chunk: int | None = None, levels: int = 2, fanout: int = 1000) -> DataFrame:
    """As `reconcile` without the rows that are the same: only ranges whose content differs are joined row by row.

    Sums are exact to the last digit of times and the last bit of doubles. The finest ranges have `chunk` keys, those of each
    level above `fanout` times as many; without a `chunk_key` (or with one that is no whole number) ranges are of hashes, the finest
    of about RANGE_ROWS rows. The sums are one small row a range, so where tables mostly agree, hardly anything is shuffled; where
    all of the largest ranges differ, sums of all rows are, but rows only from the finest ranges that differ.
    """
    whole = _whole(source, chunk_key)
    sizes = [(chunk or 10_000) * fanout**level for level in range(levels - 1, -1, -1)] if whole else None
    return reconcile(*differing_rows(source, target, keys, chunk_key, sizes), keys).filter("status <> 'same'")
