"""Personal data: four exact kinds, and more of them by bootstrapped contextual extraction.

The base kinds are found by pattern and checked (ranges, Luhn, digit counts). They are the seeds: the words around them
are lexical patterns, and each round scores the graph of patterns and the tokens they stand with: a pattern is as
good as the share of its values that are known to be of a kind, a value as good as its patterns together.
Values above the bar join the known ones and the next round starts from them, until none is new. DataFrame functions only.

Any token can be an identifier that has a digit or a mark inside, which all base kinds have, and so can a run of groups of digits. What else
an identifier of a kind must have is learned from the known ones: the classes of characters (letters, digits, marks) that nine of ten have.

The possessive and anchored forms of the four patterns below match what the plain ones match: the letters that a part
may have exclude what must follow it, so giving letters back never helps, and a mail address that fails from the start
of a run of its letters fails from inside that run. All places of a text's matches are told by sums of lengths, block by
block, so a text may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyweave.llm.common import materialize

#: The kinds in the order in which they are listed, with their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>"
#: What a token is cut at.
_CUT = r"\s\"'\[=:<>"
#: Groups of digits, parted by a mark, a space or both; else a token up to its last letter or digit, with a digit or a mark in it.
_GROUPS = r"\+?[0-9]++(?:(?:[-.\x20]|\)[-\x20]|\x20\()[0-9]++(?![\p{L}@_/]))++"
_MORE = rf"\(?+[^{_CUT}(\p{{L}}0-9]*+[\p{{L}}0-9]++"
_IDENTIFIER = rf"(?<![^{_CUT}(])(?!\()(?:{_GROUPS}|\p{{L}}*+(?:[0-9][\p{{L}}0-9]*+(?:{_MORE})*+|(?:{_MORE})++))"
#: What stands before and after a match once it is marked, in place of which the text has another character of no use.
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
#: Characters before and after a place in which the words of its patterns are looked for.
_BEFORE, _AFTER = 80, 40
#: Share of a kind's known values that must have a class of characters for it to be asked of others.
_CLASS = 0.9


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before each match; a piece has its match, then a mark, then what follows up to the next. One search a text."""
    plain = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)
    return F.split(F.regexp_replace(plain, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN, -1)


def _matches(pieces: str, passes: Column | None = None) -> Column:
    """Array of (gap, size, value, before, after) of all matches: gap and size in characters; a null value if it doesn't pass.

    pieces is a column, as an expression would be computed for every match.
    """
    whole = F.col(pieces)
    later = lambda n: F.slice(whole, n + 1, 1 << 30)
    fields = "array<struct<one:string,last:string,before_last:string,following:string>>"
    zipped = F.arrays_zip(later(1), whole, F.concat(F.array(F.lit("")), whole), later(2)).cast(fields)
    match = lambda piece: F.when(F.contains(piece, F.lit(_CLOSE)), F.substring_index(piece, _CLOSE, 1)).otherwise("")
    rest = lambda piece: F.substring_index(piece, _CLOSE, -1)

    def one(x: Column) -> Column:
        value, gap = match(x["one"]), rest(x["last"])
        ok = F.lit(True) if passes is None else passes(value)
        part = lambda text: F.when(ok, text)
        tail, front = (lambda c: F.right(c, F.lit(_BEFORE))), (lambda c: F.left(c, F.lit(_AFTER)))
        before = tail(F.concat(tail(rest(x["before_last"])), tail(match(x["last"])), tail(gap)))
        after = front(F.concat(front(rest(x["one"])), F.coalesce(front(match(x["following"])), F.lit(""))))
        return F.struct(F.length(gap).alias("gap"), F.length(value).alias("size"), part(value).alias("value"), part(before).alias("before"), part(after).alias("after"))

    return F.transform(F.filter(zipped, lambda x: x["one"].isNotNull()), one)


def _ends(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` with a column end_<name> for each array of `_matches`: where each match ends.

    Sums run within blocks of about the cube root of the number of matches, then over the blocks, as adding to an array copies it.
    """
    block = lambda c: F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(c)) * 1.26).cast("int"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def within(c: str) -> Column:
        def sums(i: Column) -> Column:
            step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["gap"] + x["size"]).alias("out"))
            return F.aggregate(F.slice(F.col(c), i * block(c) + 1, block(c)), zero, step)

        last = F.floor((F.size(c) - 1) / block(c)).cast("int")
        return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), last), sums))

    over = lambda c: F.aggregate(c, zero, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
    df = df.withColumns({f"block_{n}": within(n) for n in names})
    df = df.withColumns({f"over_{n}": over(f"block_{n}") for n in names})
    joined = lambda n: F.flatten(F.zip_with(f"block_{n}", f"over_{n}", lambda b, o: F.transform(b["out"], lambda x: x + o)))
    return df.withColumns({f"end_{n}": joined(n) for n in names}).drop(*[f"{p}_{n}" for p in ("block", "over") for n in names])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.left(short(p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        worth = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
        total = F.aggregate(F.transform(F.split(F.reverse(_digits(value)), ""), worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        return F.length(_digits(value)).between(14, 19) & (total % 10 == 0)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and others of each row of `docs` (doc_id, text): arrays of (start, rank, end, kind, value, before, after).

    base has the base kinds, by start, then kind as listed; others what else may be an identifier, without rank and kind.
    """
    names, patterns = [*PATTERNS, "other"], [*PATTERNS.values(), _IDENTIFIER]
    text, digit = F.col("text"), F.col("text").rlike("[0-9]")
    may = {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+")), "other": F.lit(True)}
    cut = {n: F.when(may[n], _pieces(text, p)) for n, p in zip(names, patterns, strict=True)}
    df = docs.select("doc_id", *[c.alias(f"pieces_{n}") for n, c in cut.items()])
    checks = {n: (lambda v, n=n: _passes(n, v)) if n in PATTERNS else None for n in names}
    df = df.select("doc_id", *[_matches(f"pieces_{n}", checks[n]).alias(n) for n in names])
    df = _ends(df, names)

    def spans(n: str) -> Column:
        at = F.filter(F.arrays_zip(F.col(n).alias("m"), F.col(f"end_{n}").alias("end")), lambda x: x["m"]["value"].isNotNull())
        own = lambda: [F.lit([*PATTERNS].index(n)).alias("rank"), F.lit(n).alias("kind")] if n in PATTERNS else [F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("kind")]
        one = lambda x: F.struct((x["end"] - x["m"]["size"]).alias("start"), own()[0], x["end"].alias("end"), own()[1], *[x["m"][c].alias(c) for c in ("value", "before", "after")])
        return F.coalesce(F.transform(at, one), F.array().cast(_SPANS))

    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(F.concat(*[spans(n) for n in PATTERNS])).alias("base"), spans("other").alias("others"))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: its two words before, and the word before with the word after; digits as 0."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    two, one, right = (F.regexp_extract(plain(c), p, 0) for c, p in ((before, r"\S+\s+\S+\s*$"), (before, r"\S+\s*$"), (after, r"^\s*\S+")))
    squeeze = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.filter(F.array(F.when(two != "", F.concat(F.lit("l:"), squeeze(two))), F.when((one != "") & (right != ""), F.concat(F.lit("m:"), squeeze(one), F.lit(" _ "), squeeze(right)))), lambda p: p.isNotNull())


def _classes(value: str) -> list[Column]:
    return [F.col(value).rlike(c) for c in (r"\p{L}", "[0-9]", r"[^\p{L}0-9]")]


def discover(seeds: DataFrame, candidates: DataFrame, rounds: int | None = None, support: int = 5, bar: float = 0.8) -> DataFrame:
    """(value, kind) of the candidates that patterns of known identifiers give away.

    seeds: pattern, value, kind; candidates: pattern, value. A pattern counts for a kind if at least `support` different
    values that it stands with are known to be of it; its confidence is their share among all different values it stands
    with, less one in doubt. A value's score is one less the product of its patterns' doubts; from `bar` on it is found, as
    the kind with the best score (of equals the one listed first) among those whose classes of characters it has, and it
    stays that. Patterns of a confidence below half the bar don't count. Rounds go on until one finds nothing new, or to `rounds`. All counts are
    pre-aggregated; each round is written to the shared folder.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind"))
    known = materialize(seeds.select("value", "kind").distinct(), "known")
    shares = [F.avg(c.cast("int")).alias(f"c{i}") for i, c in enumerate(_classes("value"))]
    needs = {r["kind"]: [r[f"c{i}"] >= _CLASS for i in range(3)] for r in known.groupBy("kind").agg(*shares).collect()}  # one row a kind
    graph = seeds.select("pattern", "value").unionByName(candidates.select("pattern", "value")).distinct()
    graph = materialize(graph, "pattern-pairs")
    graph = graph.join(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= support), "pattern")
    graph = materialize(graph, "pattern-graph")
    seen, found, number = known.select("value").distinct(), None, 0
    suits = F.lit(False)
    for kind, need in needs.items():
        fits = F.lit(True)
        for has, needed in zip(_classes("value"), need, strict=True):
            fits = fits & has if needed else fits
        suits = suits | ((F.col("kind") == kind) & fits)
    while rounds is None or number < rounds:
        good = graph.join(known, "value").groupBy("pattern", "kind", "values").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= support)
        good = good.withColumn("confidence", F.col("hits") / (F.col("values") + 1)).filter(F.col("confidence") >= bar / 2)
        scored = graph.select("pattern", "value").join(good.select("pattern", "kind", "confidence"), "pattern").filter(suits).join(seen, "value", "left_anti")
        scored = scored.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        best = scored.groupBy("value").agg(F.max(F.struct("score", (-rank).alias("rank"), "kind")).alias("best")).filter(F.col("best.score") >= bar)
        new = materialize(best.select("value", F.col("best.kind").alias("kind")), "discovered")
        found, number = new if found is None else found.unionByName(new), number + 1
        if new.isEmpty():
            break
        known, seen = known.unionByName(new), seen.unionByName(new.select("value"))
    return known.limit(0) if found is None else found


def _beside_base(spans: DataFrame) -> DataFrame:
    """row, m (of others) of what touches no base span: by the furthest end of base spans so far, and by the next one's start."""
    free = spans.filter(F.size("base") == 0).select("row", F.explode("others").alias("m"))
    some = spans.filter((F.size("base") > 0) & (F.size("others") > 0))
    both = some.select("row", F.explode(F.concat("base", "others")).alias("m")).withColumn("at", F.col("m.start"))
    base = F.col("m.kind").isNotNull()
    so_far, on = (Window.partitionBy("row").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("at"), -F.col("at")))
    both = both.withColumn("reach", F.max(F.when(base, F.col("m.end"))).over(so_far)).withColumn("next", F.min(F.when(base, F.col("m.start"))).over(on))
    apart = ~base & ~F.coalesce(F.col("reach") > F.col("m.start"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("m.end"), F.lit(False))
    return free.unionByName(both.filter(apart).select("row", "m"))


def find_personal_data(docs: DataFrame, rounds: int | None = None, support: int = 5, bar: float = 0.8) -> DataFrame:
    """One row per row of `docs`: doc_id, base and spans (arrays of start, rank, end, kind by start, then kind as listed).

    Positions count code points, ends are exclusive. spans holds base and the discovered identifiers, which never
    overlap a base span. Patterns are of the two words before a place, and of the word before with the word after, as far as they are
    among the 80 characters before or the 40 after it and not beyond the second match before or the first after; longer words are cut there. Null text is empty and has no spans. Very long texts, and ones with very many matches,
    are read whole. Rows that repeat, that share a doc_id or have none are judged each by its own text. An empty table gives no rows. Other columns are not looked
    at, whatever their names.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = materialize(located(plain), "located")  # rows get their numbers when this is written
    seeds = spans.select(F.explode("base").alias("m")).select("m.kind", "m.value", F.explode(_patterns(F.col("m.before"), F.col("m.after"))).alias("pattern"))
    places = _beside_base(spans).select("row", "m.start", "m.end", "m.value", _patterns(F.col("m.before"), F.col("m.after")).alias("patterns"))
    found = discover(seeds, places.select("value", F.explode("patterns").alias("pattern")), rounds, support, bar)
    rank = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind")).cast("int") - 1
    added = places.join(found, "value").groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("added"))
    slim = "array<struct<start:int,rank:int,end:int,kind:string>>"
    base = F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"), m["kind"].alias("kind")))
    joined = spans.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(slim)))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find_personal_data`'s rows."""
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
