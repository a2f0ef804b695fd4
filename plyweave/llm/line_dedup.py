"""Removal of boilerplate lines that spread over many sites.

Each line is named by 96 bits of hash. Per line a HyperLogLog sketch of the sites that have it is merged by
aggregation, so a line that stands in a third of all rows is combined before it is shuffled. A line whose estimate is
clearly below or above the threshold is decided by it; those near it get an exact distinct count. The first occurrence
of a boilerplate line stays, all others go, however short or long the line is. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import materialize

#: Relative distance from the threshold within which an estimate isn't trusted: over five standard errors of the sketch.
NEAR = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(lines: DataFrame, sites: int, near: float = NEAR, lg_k: int = 12) -> DataFrame:
    """(h1, h2, first) of the lines that at least `sites` different sites have; first: its smallest (id, tag, pos)."""
    seen = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("about"), F.min(F.struct("id", "tag", "pos")).alias("first"))
    seen = materialize(seen.filter(F.col("about") >= sites * (1 - near)), "spread-lines")
    close = seen.filter(F.col("about") <= sites * (1 + near))
    exact = lines.join(close.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("exactly"))
    far = seen.filter(F.col("about") > sites * (1 + near))
    return far.drop("about").unionByName(close.drop("about").join(exact.filter(F.col("exactly") >= sites).drop("exactly"), ["h1", "h2"]))


def remove_boilerplate(docs: DataFrame, sites: int = 8, site: str = "source", n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """`docs` with text without its boilerplate lines; with columns of the given names for the counts of lines, if any.

    A line is what stands between line feeds, compared exactly; only blank ones are never boilerplate. Null text stays
    null and has no lines; an empty text has one empty line; a text that loses all lines becomes empty; very long texts
    are read whole. A null site is no site. The first occurrence is that of the smallest doc_id (null ones last, among
    which a hash of text and site decides), then the first in it; rows that repeat doc_id, text and site keep it each.
    n_chars, if there, becomes the new text's length. All rows and columns stay, but that columns of the names given for
    counts are replaced; other names never clash. An empty table stays empty.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, home = F.col("row.text").cast("string"), F.col(f"row.`{site}`").cast("string")
    named = row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text, home).alias("tag"))
    lines = named.select("id", "tag", home.alias("site"), F.posexplode(_lines(text)).alias("pos", "line")).filter(F.col("line").rlike(r"[^\x09-\x0D\x20]"))
    lines = materialize(lines.select("id", "tag", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")), "lines")
    found = boilerplate(lines, sites)
    gone = lines.join(found, ["h1", "h2"]).filter(F.struct("id", "tag", "pos") != F.col("first"))
    gone = gone.groupBy("id", "tag").agg(F.collect_set("pos").alias("gone"))
    # The text goes through the join once, in its row.
    joined = named.join(gone, ["id", "tag"], "left").withColumn("all", _lines(text))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    joined = joined.withColumn("left", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("all", i + 1)), "\n")))
    old = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    columns = [old.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c not in (n_lines, n_removed)]
    size = lambda array: F.when(F.col(array).isNull(), 0).otherwise(F.size(array))
    counts = [(n_lines, size("all")), (n_removed, size("gone"))]
    return joined.select(*columns, *[value.cast("long").alias(name) for name, value in counts if name])


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; null: empty)."""
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM split),
spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM line WHERE regexp_matches(line, '[^\x09-\x0D\x20]')
  GROUP BY line HAVING count(DISTINCT source) >= 8),
judged AS (SELECT l.*, s.first IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone FROM line l LEFT JOIN spread s USING (line)),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN cleaned USING (doc_id)
"""
