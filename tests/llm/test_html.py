from __future__ import annotations

import html
import re

import pytest

from pyspark.sql import functions as F

from plyweave.llm.html_text import FEW_WORDS, Page, extract, host_of, left_over, subtree_counts, templates, votes

SCHEMA = "page_id long, url string, html string, text int, tree int"


def text(source):
    return Page(source).text(lambda i: False)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b", "a\nb"),
        ("<body><nav>menu</nav><article><h1>T &copy;</h1><p>x  <b>y</b>\n z<br>w</p></article><footer>f</footer>", "T ©\nx y z w"),
        ("<script>var t='</p><p>no';</script><p>yes</p>", "yes"),
        ("<article><p>a</p><div class='comments'><p>reader says</p></div><aside>side</aside><form><p>sign up</p></form></article><p>out</p>", "a"),
        ("<article>one</article><div>between</div><article>two</article>", "one\ntwo"),
        ("<div class=\"ad-box\">buy</div><div id='main-content'>text</div>", "text"),
        ("<header>site</header><article><header><h1>T</h1></header>body</article>", "T\nbody"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1 2\n3"),
        ("<p>a<!-- <p>gone</p> -->b<!-- open <p>x", "ab"),
        ("<p title=\"x>y\">a</p><p>b <i", "a\nb"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p>&lt;b&gt; &#233; &nope;</p>", "<b> é &nope;"),
        ("</div></p>x</article>", "x"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ],
)
def test_text(source, want):
    assert text(source) == want


def test_long_and_deep_pages():
    assert text("<div>" * 3000 + "x") == "x"
    assert len(text("<article>" + "<p>word</p>" * 20_000)) == 5 * 20_000 - 1


def test_templates_of_a_host_go(spark):
    rows = [(i, f"http://A.com/{i}", f"<div><ul><li>home</li><li>shop</li></ul></div><section><p>own text {i}</p></section><div>all rights</div>", 0, 0) for i in range(9)]
    rows += [(100 + i, f"http://b{i}.com/", "<div>all rights</div><p>x</p>", 0, 0) for i in range(9)]
    rows += [(200, None, None, None, None), (201, "http://[bad", "<p>t</p>", None, None), (200, None, "<p>twice</p>", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (1000, 0):
        got = extract(df, most_broadcast=most).collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r["text"] for r in got}
        assert all(by[i] == f"own text {i}" for i in range(9))
        assert all(by[100 + i] == "all rights\nx" for i in range(9))
        assert sorted(r["text"] for r in got if r["page_id"] == 200) == ["", "twice"]
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(df.limit(0)).count() == 0


def test_copies_of_a_page_are_one_vote(spark):
    wrapped = lambda x: f"<body><div class=wrap><article><p>{x}</p></article></div></body>"
    bare = lambda x: f"<body><div class=text><p>{x}</p></div><div>all rights</div></body>"
    pages = [(page("the same" if i < 6 else f"own {i}"), host) for host, page in (("a", wrapped), ("b", bare)) for i in range(12)]
    df = spark.createDataFrame([(i, f"http://{host}.com/?ref={i}", source, 0, 0) for i, (source, host) in enumerate(pages)], SCHEMA)
    for most in (1000, 0):
        got = {r["page_id"]: r["text"] for r in extract(df, most_broadcast=most).collect()}
        assert [got[i] for i in range(24)] == (["the same"] * 6 + [f"own {i}" for i in range(6, 12)]) * 2


def test_wrappers_of_articles_are_no_template(spark):
    rows = [(i, "http://a.com/", f"<i>{i}</i><div class=wrap><article><p>the same</p></article></div>", 0, 0) for i in range(9)]
    assert {r["text"] for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"the same"}


def test_boxes_that_recur_in_articles_go(spark):
    box = "<div class=x1><p>Join 5,000 readers</p></div>"
    rows = [(i, "http://a.com/", f"<main><div><p>own {i}</p></div>{box}</main>", 0, 0) for i in range(9)]
    rows += [(20 + i, "http://b.com/", f"<i>{i}</i><main><div><p>{'copied' if i < 6 else i}</p></div></main>", 0, 0) for i in range(9)]
    rows += [(40 + i, "http://c.com/", f"<main><hr title={i}><div><p>all there is</p></div></main>", 0, 0) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (1000, 0):
        got = {r["page_id"]: r["text"] for r in extract(df, most_broadcast=most).collect()}
        assert [got[i] for i in range(9)] == [f"own {i}" for i in range(9)]
        assert [got[20 + i] for i in range(9)] == ["copied"] * 6 + ["6", "7", "8"]
        assert {got[40 + i] for i in range(9)} == {"all there is"}


def test_passages_shared_by_articles_stay(spark):
    rows = [(i, "http://a.com/", f"<nav>n</nav><article><p>shared passage</p><p>{i}</p></article>", 0, 0) for i in range(10)]
    got = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["text"] for r in got) == sorted(f"shared passage\n{i}" for i in range(10))


def test_whole_table_against_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)\b[^>]*>", article))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_subtree_counts_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html")
    rows = [(r["url"], r["html"]) for r in pages.collect()]
    twice = pages.union(spark.createDataFrame([(u + "#x", h) for u, h in rows[:40]], "url string, html string"))
    want = {}
    for host, source in {(host_of(u), h) for u, h in rows}:
        page = Page(source)
        for kind, trees in ((False, page.subtrees()), (True, page.shapes())):
            for i, tree in trees:
                want.setdefault((host, tree, kind), set()).add(page.main_hash() if not kind and page.main[i] else source)
    for least in (2, 5):
        counts, hosts = subtree_counts(votes(twice), least)
        assert {(r["host"], r["tree"], r["shape"]): r["n"] for r in counts.collect()} == {k: len(v) for k, v in want.items() if len(v) >= least}
        assert {r["host"] for r in hosts.collect()} == {h for h in map(host_of, dict(rows)) if sum(host_of(u) == h for u, _ in rows) >= least}


def test_templates_find_the_text_without_articles(spark):
    """No element or name tells the content of these pages: what recurs on the host by shape goes, and what is left over is the text."""
    page = lambda i: f"<div class=a{i}>top {i}</div><div class=k><div>menu {i} <a href=/{i}>x</a></div></div><div class=z><h2>title {i}</h2><p>{'long text ' * 20}{i}</p></div><div class=q>offer {i}</div>"
    df = spark.createDataFrame([(i, "http://a.com/", page(i), 0, 0) for i in range(8)], SCHEMA)
    off = {r["page_id"]: r["text"] for r in extract(df, cut_templates=False).collect()}
    for most in (1000, 0):
        got = {r["page_id"]: r["text"] for r in extract(df, most_broadcast=most).collect()}
        assert got == {i: f"title {i}\n{'long text ' * 20}{i}" for i in range(8)}
    assert all(off[i] == f"top {i}\nmenu {i} x\n{got[i]}\noffer {i}" for i in range(8))
    other = spark.createDataFrame([(9, "http://a.com/", "<section><p>another layout</p></section>", 0, 0)], SCHEMA)
    assert [r["text"] for r in extract(df.union(other)).filter("page_id = 9").collect()] == ["another layout"]


def test_whole_table_without_articles(spark):
    """With its article elements renamed, a page gives the same text. The prior alone does so too: on the given pages counts change nothing."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    want, got, prior, bare_prior = ({r["page_id"]: r["text"] for r in df.collect()} for df in (extract(pages), extract(bare), extract(pages, cut_templates=False), extract(bare, cut_templates=False)))
    assert got == want
    assert sum(want[i] != prior[i] for i in want) == sum(want[i] != bare_prior[i] for i in want) == 0


LONG = "A long answer with many words that says what is to be said about this matter, and more. " * 12


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (lambda i: f"<div class=post><div class=lead>What happened on day {i} in the town, told in short.</div><div class=text><p>{LONG}{i}</p></div></div>", lambda i: f"What happened on day {i} in the town, told in short.\n{LONG}{i}"),
        (lambda i: f"<div class=q>How do I do number {i}?</div><div class=a><p>{LONG}{i}</p></div>", lambda i: f"How do I do number {i}?\n{LONG}{i}"),
        (lambda i: f"<div class=t><h1>Title {i}</h1></div><div class=a><p>{LONG}{i}</p></div><div class=x{i}>menu {i}</div>", lambda i: f"Title {i}\n{LONG}{i}"),
        (lambda i: f"<div class=w><a href=/{i}>One {i} here now.</a> <a href=/x>Another {i}.</a></div><div class=b>Same words.</div><div class=a><p>{LONG}{i}</p></div><div class=s>offer {i}</div>", lambda i: f"{LONG}{i}"),
        (lambda i: f"<div class=k><p>Read the story number {i // 4} next.</p></div><div class=a><p>{LONG}{i}</p></div>", lambda i: f"{LONG}{i}"),
    ],
)
def test_prose_beside_the_content_stays(spark, page, want):
    """A lead, a question or a title that differs from page to page is text; links, repeated and few words of one shape are none."""
    df = spark.createDataFrame([(i, "http://a.com/", page(i), 0, 0) for i in range(10)], SCHEMA)
    for most in (1000, 0):
        got = {r["page_id"]: r["text"] for r in extract(df, most_broadcast=most).collect()}
        assert got == {i: want(i).strip() for i in range(10)}


def brute_left(page, trees):
    """Characters at each content place and depth, by walking up from every run."""
    tree = dict(page.subtrees())
    goes = [page.no_text[i] or page.named[i] or tree.get(i) in trees for i in range(len(page.tags))]
    up = lambda i: [i, *up(page.parent[i])] if i >= 0 else []
    places, out = dict(page.content_places()), {0: [0, 0]}
    for element, start, end, _ in page.runs:
        above = up(element)
        if any(goes[i] for i in above):
            continue
        size = len("".join(page.source[start:end].split()))
        out[0][0] += size
        for k, i in enumerate(above):
            if i in places and size:
                out.setdefault(places[i], [0, 0])[0] += size
                out[places[i]][1] = len(above) - k
    return {k: tuple(v) for k, v in out.items()}


def test_choice_of_content_against_brute_force(spark):
    """What is left over, the place of the content and the shapes that go, over a whole table and a made-up host."""
    made = [(None, f"http://made.com/{i}", f"<div class=top>hello {i}</div><div class=o><div class=i><p>{LONG * (1 + i % 2)}{i}</p></div><div class=n>note {i}</div></div><div>same</div>") for i in range(7)]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(made, "page_id long, url string, html string"))
    rows = {(host_of(r["url"]), r["html"]) for r in pages.collect()}
    hosts = {}
    for host, source in sorted(rows):
        hosts.setdefault(host, []).append(Page(source))
    want = set()
    for host, found in hosts.items():
        if len(found) < 5:
            continue
        n, articles = {}, {}
        for p in found:
            for i, t in set(p.subtrees()):
                articles.setdefault(t, set()).add(p.main_hash() if p.main[i] else p.source)
        same = {t for t, x in articles.items() if len(x) >= max(5, 0.3 * len(found))}
        want |= {(host, t) for t in same}
        left, depth = {}, {}
        for p in found:
            brute = brute_left(p, same)
            assert {k: v for k, v in left_over(p.skeleton(), same).items() if v[0] or not k} == {k: v for k, v in brute.items() if v[0] or not k}
            for k, (size, d) in brute.items():
                left[k], depth[k] = left.get(k, 0) + size, max(depth.get(k, 0), d)
        content = max(((depth[k], left[k], k) for k in left if k and left[k] >= 0.8 * left[0] and left[k]), default=None)
        if content is None:
            continue
        want.add((host, content[2]))
        for p in found:
            for shape, said in p.said().items():
                n.setdefault(shape, []).append(said)
        for shape, said in n.items():
            texts, words, linked, prose = len({x[0] for x in said}), sum(x[1] for x in said), sum(x[2] for x in said), sum(x[3] for x in said)
            if len(said) >= 5 and (2 * texts <= len(said) or 2 * linked >= words or (words - linked <= FEW_WORDS * len(said) and 2 * prose < len(said))):
                want.add((host, shape))
    for most in (10**6, 0):
        got = {tuple(r) for r in templates(pages.select("url", "html"), 5, 0.3, 0.8, most).collect()}
        assert got == want
    assert any(h == "made.com" for h, _ in want) and len(want) > 50
