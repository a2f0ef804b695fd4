"""Main text of web pages: site templates are found by counting element subtrees per host, then cut away.

An element's subtree is hashed twice: with its content, and by its shape alone, which is where it stands and what blocks
it is made of, with their names but without text. Menus, adverts and footers that change from page to page recur by shape. Both hashes are
counted over a host's distinct pages in Spark (copies of a page are one vote), a page's votes being one row.

1. Content that at least `least_pages` and a `share` of a host's pages have is template. Inside an article or main element only boxes
   (divisions, lists, tables and the like) are, counted over distinct articles: passages that a site's articles share are text.
2. What is left over tells where a host's content is: the deepest box whose place in the page holds `least_left` of all characters.
3. Beside that box, a subtree goes by its shape, whatever it says, if `least_pages` of the host's pages have the shape and what they have in it
   reads like a template: the same on most pages, or mostly links, or a few words that are no sentence. Prose that differs
   from page to page (a lead before the text, a question before its answer) stays.

Counts can't tell about hosts of few pages, pages without the box, subtrees of rare shapes and what stands inside the box.
There a prior decides: an article or main element is the content, and the names below are none. What HTML's own elements
say (nav, footer, aside, form and the like) holds everywhere.
"""

from __future__ import annotations

import functools
import html as entities
import re
from bisect import bisect_left
from collections.abc import Callable, Container, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyweave.llm.common import batch_of, materialize, rows_of

# Names of HTML elements by how they bear on text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "caption", "html", "legend", "tbody", "tfoot", "thead", "tr"}
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOX = frozenset("address center details div dl fieldset figure header hgroup ol section table ul".split())
_HOLDS = frozenset("ul ol dl table menu select".split())
_NO_TEXT = frozenset("nav footer aside form button select dialog menu svg canvas audio video object head".split())
# The prior, words in class, id or role that name menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
_NO_TEXT_WORDS = frozenset(
    "menu nav navbar navigation breadcrumbs footer contentinfo sidebar complementary alert banner consent cookie cookies notice popup ad ads advert advertisement promo sponsored "
    "form login newsletter search signup subscribe share social related comment comments replies respond".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[/a-zA-Z!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"')\]\u201d\u2019\u00bb]*(?:[\s&]|\Z)")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A few words: what the elements of a shape have on average at most, without links, if they are no text.
FEW_WORDS = 5
#: What marks the hash of the place of a host's content, and that of a shape, among hashes of subtrees.
_CONTENT, _SHAPE = "content ", "shape "


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _names(attributes: str) -> list[tuple[str, str]]:
    return [(name.lower(), "".join(values)) for name, *values in _NAMES.findall(attributes)] if attributes else []


def _no_text(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether HTML itself says that an element has no main text."""
    return tag in _NO_TEXT or tag in _RAW or (tag == "header" and not in_main) or bool(attributes and _HIDDEN.search(attributes))


def _named_no_text(tag: str, names: list[tuple[str, str]], in_main: bool) -> bool:
    """Whether an element's names say so: the prior."""
    for name, value in names:
        words = {w.lower() for w in _WORDS.findall(value)}
        if words & _NO_TEXT_WORDS or (not in_main and "header" in words and tag not in ("body", "main", "article")) or (name == "role" and "form" in words):
            return tag not in ("body", "html", "main") or bool({"comment", "comments"} & words)
    return False


class Page:
    """The elements of a page in order of their start tags, and the text runs between tags."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.tags: list[str] = []
        self.no_text: list[bool] = []  # by HTML itself
        self.named: list[bool] = []  # as no text, by the prior
        self.place: list[int] = []  # hash of the element's and its ancestors' labels
        self.main: list[bool] = []  # is an article or main element, or lies in one
        self.begin: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.runs: list[tuple[int, int, int, bool]] = []  # element, start, end (an empty run is a space), whether a block ends before
        self._read()

    def _read(self) -> None:
        source, stack, at, broken = self.source, [], 0, True
        tags, runs = self.tags, self.runs
        while True:
            found = _TAG.search(source, at)
            start = found.start() if found else len(source)
            if start > at:
                runs.append((stack[-1] if stack else -1, at, start, broken))
                broken = False
            if not found:
                break
            at, closing, tag = found.end(), found[1], found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                if tag in _BLOCK:
                    broken = True
                place = next((i for i in range(len(stack) - 1, -1, -1) if tags[stack[i]] == tag), None)
                if place is not None:
                    for i in stack[place:]:
                        self.end[i] = found.start() if i != stack[place] else at
                    del stack[place:]
                continue
            if tag == "br":
                runs.append((stack[-1] if stack else -1, start, start, broken))
                broken = False
                continue
            if tag in _BLOCK:
                broken = True
            self._end_implied(tag, stack, start)
            parent = stack[-1] if stack else -1
            if tag in ("td", "th"):
                runs.append((parent, start, start, broken))
                broken = False
            in_main = (parent >= 0 and self.main[parent]) or tag in ("article", "main")
            number = len(tags)
            tags.append(tag)
            names = _names(found[3])
            self.no_text.append(_no_text(tag, found[3].strip(), in_main))
            self.named.append(_named_no_text(tag, names, in_main))
            label = " ".join([tag, *sorted({w.lower() for name, value in names if name != "role" for w in _WORDS.findall(value)})])
            self.place.append(hash_of(f"{self.place[parent] if parent >= 0 else 0} {label}"))
            self.main.append(in_main)
            self.begin.append(start)
            self.end.append(len(source))
            self.parent.append(parent)
            if tag in _VOID or found[3].endswith("/") and tag not in _BLOCK and tag not in _RAW:
                self.end[number] = at
            elif tag in _RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at) if tag not in _CLOSE else _CLOSE[tag].search(source, at)
                at = close.end() if close else len(source)
                self.end[number] = at
            else:
                stack.append(number)

    def _end_implied(self, tag: str, stack: list[int], start: int) -> None:
        """Elements that this start tag ends: an open p, or the item before it in its list or table."""
        ends = {"p"} if tag in _ENDS_P else set()
        ends |= _ENDED_BY.get(tag, set())
        if not ends:
            return
        for i in range(len(stack) - 1, -1, -1):
            name = self.tags[stack[i]]
            if name in ends:
                for x in stack[i:]:
                    self.end[x] = start
                del stack[i:]
                if name != "p":
                    return
            elif name in _HOLDS or name in ("article", "body", "main", "section", "div", "td", "th"):
                return

    def holds_main(self) -> list[bool]:
        """Whether each element is an article or main element or has one in it."""
        out = [tag in ("article", "main") for tag in self.tags]
        for i in range(len(out) - 1, -1, -1):
            if out[i] and self.parent[i] >= 0:
                out[self.parent[i]] = True
        return out

    def subtrees(self) -> list[tuple[int, int]]:
        """(element, hash of its subtree with content), white space counted as one space.

        Of the elements outside the article that hold none, and of the boxes inside it, whose hashes are others.
        """
        out, holds = [], self.holds_main()
        for i, tag in enumerate(self.tags):
            if not holds[i] and (tag in _BOX if self.main[i] else tag not in ("html", "body", "head")):
                out.append((i, hash_of("main " * self.main[i] + " ".join(self.source[self.begin[i] : self.end[i]].split()))))
        return out

    def shapes(self) -> list[tuple[int, int]]:
        """(element, hash of its place and of the blocks in it), of all but prose; runs of like blocks count as one, inline elements as none."""
        below: list[list[int]] = [[] for _ in self.tags]  # of blocks: the shapes of the blocks right below, last first
        block, shape = [], [0] * len(self.tags)
        for up in self.parent:
            block.append(up if up < 0 or self.tags[up] in _BLOCK else block[up])
        for i in range(len(self.tags) - 1, -1, -1):
            inside = below[i][::-1]
            shape[i] = hash_of(" ".join([_SHAPE, str(self.place[i]), *(str(x) for j, x in enumerate(inside) if not j or x != inside[j - 1])]))
            if block[i] >= 0 and self.tags[i] in _BLOCK:
                below[block[i]].append(shape[i])
        return [(i, x) for i, x in enumerate(shape) if self.tags[i] not in _PROSE and self.tags[i] not in ("html", "body", "head")]

    @functools.cached_property
    def said_in_runs(self) -> list[tuple[str, int]]:
        """Text, white space as one space, and words of each run."""
        parts = [self.source[start:end].split() for _, start, end, _ in self.runs]
        return [(" ".join(p), len(p)) for p in parts]

    def said(self) -> dict[int, tuple[int, int, int, bool]]:
        """For each shape what its elements say: hash of their text, words, those of them in links, and whether there is a sentence or a heading."""
        count, begins = len(self.runs), [r[1] for r in self.runs]
        link, heads = [], [0]
        for tag, up in zip(self.tags, self.parent, strict=True):
            link.append(tag == "a" or up >= 0 and link[up])
            heads.append(heads[-1] + (tag in _HEADINGS))
        words, linked, ends, hashes = [0], [0], [0], []
        for (element, *_), (text, n) in zip(self.runs, self.said_in_runs, strict=True):
            words.append(words[-1] + n)
            linked.append(linked[-1] + (n if element >= 0 and link[element] else 0))
            ends.append(ends[-1] + (1 if _SENTENCE_END.search(text) else 0))
            hashes.append(text)
        out: dict[int, tuple[int, int, int, bool]] = {}
        for i, shape in self.shapes():
            a, b = bisect_left(begins, self.begin[i]), bisect_left(begins, self.end[i], hi=count)
            inner = bisect_left(self.begin, self.end[i])
            had = out.get(shape, (0, 0, 0, False))
            text = hash_of(f"{had[0]} " + " ".join(t for t in hashes[a:b] if t))
            out[shape] = (text, had[1] + words[b] - words[a], had[2] + linked[b] - linked[a], had[3] or ends[b] > ends[a] or heads[inner] > heads[i])
        return out

    def content_places(self) -> list[tuple[int, int]]:
        """(element, hash of its place) of what may be a host's content: boxes, article and main elements, but not those in an article or main element."""
        may = ((i, tag, self.parent[i]) for i, tag in enumerate(self.tags))
        return [(i, hash_of(f"{_CONTENT}{self.place[i]}")) for i, tag, up in may if (tag in _BOX or tag in ("article", "main")) and not (up >= 0 and self.main[up])]

    def main_hash(self) -> int:
        """Hash of the outermost article and main elements."""
        outer = [i for i in range(len(self.tags)) if self.main[i] and (self.parent[i] < 0 or not self.main[self.parent[i]])]
        return hash_of(" ".join(" ".join(self.source[self.begin[i] : self.end[i]].split()) for i in outer))

    def skeleton(self) -> list[tuple[int, int | None, bool, int, int | None]]:
        """(parent, subtree's hash, whether it goes by HTML or the prior, characters of its own, its place if it may be the content) of each element.

        The first is the whole page; parents are counted from there.
        """
        tree, place = dict(self.subtrees()), dict(self.content_places())
        own = [0] * (len(self.tags) + 1)
        for (element, *_), (text, n) in zip(self.runs, self.said_in_runs, strict=True):
            own[element + 1] += len(text) - max(n - 1, 0)
        out: list[tuple[int, int | None, bool, int, int | None]] = [(-1, None, False, own[0], None)]
        out += [(self.parent[i] + 1, tree.get(i), self.no_text[i] or self.named[i], own[i + 1], place.get(i)) for i in range(len(self.tags))]
        return out

    def text(self, template: Callable[[int], bool] = lambda i: False, of_site: Container[int] = frozenset()) -> str:
        """Blocks of main text, one a line.

        template(element) tells which elements are the site's by their content. of_site holds the shapes that are
        the site's and the place of its content. Boxes of an article stay if nothing would be left without them. Without both
        the prior decides alone.
        """
        content, gone = [i for i, at in self.content_places() if at in of_site] if of_site else [], self._gone(template)
        known = any(not gone[i] for i in content)
        found = self._beside(content, template, of_site) if known else self._by_prior(template)
        return found or self._by_prior(lambda i: not self.main[i] and template(i))

    def _gone(self, more: Callable[[int], bool]) -> list[bool]:
        """Which elements go, by HTML itself, `more` or with their parents."""
        gone: list[bool] = []
        for i, parent in enumerate(self.parent):
            gone.append((parent >= 0 and gone[parent]) or self.no_text[i] or more(i))
        return gone

    def _by_prior(self, template: Callable[[int], bool]) -> str:
        gone = self._gone(lambda i: self.named[i] or template(i))
        only_main = any(main and not g for main, g in zip(self.main, gone, strict=True))
        return self._left(lambda element: only_main if element < 0 else gone[element] or only_main and not self.main[element])

    def _beside(self, content: list[int], template: Callable[[int], bool], of_site: Container[int]) -> str:
        """Where the site's content is known: what is the site's by content or, beside it, by shape goes, and what the names say."""
        holds, inside = set(), [False] * len(self.tags)
        for i in content:
            inside[i] = True
            while i >= 0 and i not in holds:
                holds.add(i)
                i = self.parent[i]
        for i, parent in enumerate(self.parent):
            inside[i] = inside[i] or parent >= 0 and inside[parent]
        shaped = {i for i, shape in self.shapes() if shape in of_site and not inside[i]}
        gone = self._gone(lambda i: i not in holds and (self.named[i] or template(i) or i in shaped))
        return self._left(lambda element: element >= 0 and gone[element])

    def _left(self, gone: Callable[[int], bool]) -> str:
        blocks: list[list[str]] = [[]]
        cut = True
        for element, start, end, broken in self.runs:
            cut = cut or broken
            if gone(element):
                continue
            if cut:
                blocks.append([])
                cut = False
            blocks[-1].append(self.source[start:end] if end > start else " ")
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


def left_over(skeleton: list[tuple[int, int | None, bool, int, int | None]], of_site: Container[int]) -> dict[int, tuple[int, int]]:
    """Characters that are left at each place that may be a host's content, and its depth, without the site's and the prior's; 0 is the whole page."""
    gone, depth, size = [], [], []
    for up, tree, goes, own, _ in skeleton:
        gone.append(up >= 0 and gone[up] or goes or tree is not None and tree in of_site)
        depth.append(depth[up] + 1 if up >= 0 else 0)
        size.append(0 if gone[-1] else own)
    for i in range(len(skeleton) - 1, 0, -1):
        size[skeleton[i][0]] += size[i]
    out = {0: (size[0], 0)}
    for i, (*_, place) in enumerate(skeleton):
        if place is not None and size[i]:
            out[place] = (out.get(place, (0, 0))[0] + size[i], depth[i])
    return out


_SAID = pa.list_(pa.struct([("tree", pa.int64()), ("text", pa.int64()), ("words", pa.int64()), ("linked", pa.int64()), ("prose", pa.bool_())]))
_PARTS = {"parent": pa.int32(), "tree": pa.int64(), "goes": pa.bool_(), "own": pa.int64(), "place": pa.int64()}


def votes(pages: DataFrame) -> DataFrame:
    """host, page, article, trees, boxes, shapes and its skeleton's columns: a row for each distinct page of a host, with the subtrees it votes for.

    page and article are hashes of the page and of its article; boxes are subtrees that articles vote for, not pages;
    of shapes there is what their elements say.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out: dict[str, list] = {c: [] for c in ("page", "article", "trees", "boxes", "shapes", *_PARTS)}
            for source in batch.column("html").to_pylist():
                page = Page(source)
                skeleton = page.skeleton()
                found = [(page.main[i - 1], part[1]) for i, part in enumerate(skeleton) if part[1] is not None]
                said = [dict(zip(("tree", "text", "words", "linked", "prose"), (shape, *x), strict=True)) for shape, x in page.said().items()]
                row = (hash_of(source), page.main_hash(), sorted({t for main, t in found if not main}), sorted({t for main, t in found if main}), said, *zip(*skeleton, strict=True))
                for to, value in zip(out.values(), row, strict=True):
                    to.append(list(value) if isinstance(value, tuple) else value)
            kinds = {"page": pa.int64(), "article": pa.int64(), "trees": pa.list_(pa.int64()), "boxes": pa.list_(pa.int64()), "shapes": _SAID} | {c: pa.list_(k) for c, k in _PARTS.items()}
            host = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())
            yield batch_of(host=host, **{c: pa.array(x, kinds[c]) for c, x in out.items()})

    schema = "host string, page long, article long, trees array<long>, boxes array<long>, shapes array<struct<tree:long,text:long,words:long,linked:long,prose:boolean>>"
    schema += ", parent array<int>, tree array<long>, goes array<boolean>, own array<long>, place array<long>"
    return pages.select("url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(read, schema).dropDuplicates(["host", "page"])


def subtree_counts(voted: DataFrame, least_pages: int) -> tuple[DataFrame, DataFrame]:
    """(host, tree, shape, n: pages with the subtree, at least `least_pages`, by its content or, if `shape`, by that, is_site; host, pages of the hosts with as many).

    is_site: of shapes, whether what the pages have in it reads like a template.
    """
    hosts = voted.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    of_pages = voted.select("host", F.explode("trees").alias("tree"))
    of_articles = voted.select("host", "article", F.explode("boxes").alias("tree")).distinct().select("host", "tree")
    trees = of_pages.unionByName(of_articles).groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")).select("host", "tree", F.lit(False).alias("shape"), "n", F.lit(True).alias("is_site"))
    said = voted.select("host", F.explode("shapes").alias("s")).select("host", "s.*")
    # First by what is said, so that different texts are counted without collecting them.
    said = said.groupBy("host", "tree", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.count_if("prose").alias("prose"))
    said = said.groupBy("host", "tree").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.sum("prose").alias("prose"))
    like = (2 * F.col("texts") <= F.col("n")) | (2 * F.col("linked") >= F.col("words")) | ((F.col("words") - F.col("linked") <= FEW_WORDS * F.col("n")) & (2 * F.col("prose") < F.col("n")))
    shapes = said.select("host", "tree", F.lit(True).alias("shape"), "n", like.alias("is_site"))
    return materialize(trees.unionByName(shapes).filter(F.col("n") >= least_pages), "subtree-counts"), materialize(hosts, "hosts")


def with_site(plain: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple[Page, str, set[int]]]]]:
    """`plain` (url, html and more) with a column `trees`, and what reads its batches: each page, its host and the known subtrees of that.

    known: host, tree. They go to the tasks if they are counted to be `most` at most; else each page gets those that are in it, by a join.
    """
    if known.limit(most + 1).count() <= most:
        of: dict[str, set[int]] = {}
        got = known.toArrow()  # at most `most` rows
        for host, tree in zip(got.column("host").to_pylist(), got.column("tree").to_pylist(), strict=True):
            of.setdefault(host, set()).add(tree)
        sent, pages = plain.sparkSession.sparkContext.broadcast(of), plain.withColumn("trees", F.lit(None).cast("array<long>"))
    else:
        keyed = plain.withColumn("key", F.xxhash64("url", "html")).withColumn("key2", F.hash("html", "url"))

        def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches):
                read = [Page(source) for source in batch.column("html").to_pylist()]
                found = [{t for _, t in p.subtrees()} | {t for _, t in p.shapes()} | {t for _, t in p.content_places()} for p in read]
                of = np.repeat(np.arange(len(found)), [len(f) for f in found])
                own = {c: batch.column(c).take(pa.array(of)) for c in ("key", "key2")}
                hosts = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string()).take(pa.array(of))
                yield batch_of(**own, host=hosts, tree=pa.array([t for f in found for t in f], pa.int64()))

        own = keyed.mapInArrow(trees, "key long, key2 int, host string, tree long").distinct().join(known, ["host", "tree"], "left_semi")
        own = own.groupBy("key", "key2").agg(F.collect_set("tree").alias("trees"))
        sent, pages = None, keyed.join(own, ["key", "key2"], "left").withColumn("trees", F.coalesce("trees", F.array().cast("array<long>"))).drop("key", "key2")

    def read(batch: pa.RecordBatch) -> Iterator[tuple[Page, str, set[int]]]:
        for url, source, own in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "trees")), strict=True):
            host = host_of(url)
            yield Page(source), host, set(own) if own is not None else sent.value.get(host, set())

    return pages, read


def _known_trees(voted: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, Callable[[str], set[int]]]:
    """`voted` with a column `known`: the known subtrees (host, tree) of each page, if they are more than `most`; else what gives a host's."""
    if known.limit(most + 1).count() > most:
        own = voted.select("host", "page", F.explode(F.concat("trees", "boxes")).alias("tree")).join(known, ["host", "tree"], "left_semi")
        return voted.join(own.groupBy("host", "page").agg(F.collect_set("tree").alias("known")), ["host", "page"], "left"), lambda host: set()
    of: dict[str, set[int]] = {}
    got = known.toArrow()  # at most `most` rows
    for host, tree in zip(got.column("host").to_pylist(), got.column("tree").to_pylist(), strict=True):
        of.setdefault(host, set()).add(tree)
    sent = voted.sparkSession.sparkContext.broadcast(of)
    return voted.withColumn("known", F.lit(None).cast("array<long>")), lambda host: sent.value.get(host, set())


def templates(pages: DataFrame, least_pages: int, share: float, least_left: float, most_broadcast: int) -> DataFrame:
    """host, tree: what a host's pages have in common, by content, and, where its content has a place of its own, that place and the shapes that are the site's."""
    voted = materialize(votes(pages), "page-votes")
    counts, hosts = subtree_counts(voted, least_pages)
    same = counts.filter(~F.col("shape")).join(hosts, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "tree")
    same = materialize(same, "templates")
    with_known, of_host = _known_trees(voted.join(hosts.select("host"), "host", "left_semi"), same, most_broadcast)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int64()), ("depth", pa.int32()), ("chars", pa.int64())]))
        for batch in rows_of(batches):
            found = []
            columns = [batch.column(c).to_pylist() for c in ("host", "known", *_PARTS)]
            for host, own, *parts in zip(*columns, strict=True):
                left = left_over(list(zip(*parts, strict=True)), set(own) if own else of_host(host))
                found.append([{"place": at, "depth": depth, "chars": chars} for at, (chars, depth) in left.items()])
            yield batch_of(host=batch.column("host"), found=pa.array(found, kind))

    left = with_known.select("host", "known", *_PARTS).mapInArrow(places, "host string, found array<struct<place:long,depth:int,chars:long>>")
    left = left.select("host", F.explode("found").alias("f")).groupBy("host", F.col("f.place").alias("place")).agg(F.max("f.depth").alias("depth"), F.sum("f.chars").alias("chars"))
    left = materialize(left, "left-over")
    whole = left.filter(F.col("place") == 0).select("host", F.col("chars").alias("all"))
    most = left.filter(F.col("place") != 0).join(whole, "host").filter((F.col("chars") > 0) & (F.col("chars") >= least_left * F.col("all")))
    content = most.groupBy("host").agg(F.max_by("place", F.struct("depth", "chars", "place")).alias("tree"))
    shapes = counts.filter("shape AND is_site").select("host", "tree").join(content.select("host"), "host", "left_semi")
    return materialize(same.unionByName(content.select("host", "tree")).unionByName(shapes).distinct(), "site")


def extract(pages: DataFrame, least_pages: int = 5, share: float = 0.3, least_left: float = 0.8, most_broadcast: int = 200_000, cut_templates: bool = True) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points of text).

    See the top of this module for what is a site's template; pages of a host that are equal count as one, and for what lies in
    an article or main element pages with equal ones; what holds such an element never is template. Null html is
    empty, and an empty page has empty text; pages without a host in their url are one host. Rows that repeat a page_id
    are pages of their own. Very long and deeply nested pages are read whole. Of the places that hold `least_left` of what
    is left the deepest counts, of equally deep ones that with most characters, then the greatest hash. An empty table gives no rows. Other columns are not looked at, whatever their names.

    Up to `most_broadcast` subtrees go to every task; more are joined to the pages' subtrees instead. The texts are the
    same. Without `cut_templates` the prior decides alone, and nothing is counted: the difference is what templates do.
    """
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    if cut_templates:
        with_trees, read = with_site(plain, templates(plain, least_pages, share, least_left, most_broadcast), most_broadcast)
    else:
        with_trees, read = with_site(plain, plain.sparkSession.createDataFrame([], "host string, tree long"), most_broadcast)

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = []
            for page, _, trees in read(batch):
                same = {i for i, tree in page.subtrees() if tree in trees} if trees else ()
                texts.append(page.text(same.__contains__, trees))
            kept = {c: batch.column(c) for c in ("page_id", "url")}
            yield batch_of(**kept, text=pa.array(texts, pa.string()), n_chars=np.array([len(t) for t in texts], np.int64))

    kind = dict(pages.dtypes)["page_id"]
    return with_trees.mapInArrow(texts_of, f"page_id {kind}, url string, text string, n_chars long")
