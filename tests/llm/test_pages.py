"""Operator 12: suffix ranks and covers against plain search, pages against a plain reading of them."""

import random
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from fixtures import CLASHING
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalake.llm import mainblocks, pages

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_suffix_classes(depth):
    rng = random.Random(depth)
    for n in (0, 1, 2, 7, 60, 300):
        s = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(n)]
        got = pages.suffix_classes(np.array(s, np.int64), depth)
        keys = [tuple(s[i:i + depth]) for i in range(n)]
        order = sorted(keys)
        assert got.tolist() == [order.index(k) for k in keys]


def plain_covered(docs, p):
    """Windows of least_run tokens, edges shown as None, looked up in a dict."""
    run, at, where = p.least_run, [], defaultdict(set)
    for d, doc in enumerate(docs):
        s = [None] * (run - 1) + list(doc) + [None] * (run - 1)
        for i in range(len(s) - run + 1):
            if any(x is not None for x in s[i:i + run]):
                where[tuple(s[i:i + run])].add(d)
                at.append((d, i, tuple(s[i:i + run])))
    # copies: the same rarest windows
    same = defaultdict(set)
    for d in range(len(docs)):
        own = [(len(where[w]), w) for e, _, w in at if e == d]
        least = min((n for n, _ in own), default=0)
        same[d] = frozenset(w for n, w in own if n == least)
    content = {d: min((e for e in range(len(docs)) if same[e] & same[d] or e == d)) for d in range(len(docs))}
    need = max(p.least_pages, int(np.ceil(p.least_share * len(set(content.values())))))
    out = [[False] * len(doc) for doc in docs]
    for d, i, w in at:
        if len({content[e] for e in where[w]}) >= need:
            for j in range(i - run + 1, i + 1):
                if 0 <= j < len(docs[d]):
                    out[d][j] = True
    return out


@pytest.mark.parametrize("seed", range(6))
def test_covered(seed):
    rng = random.Random(seed)
    p = pages.PageParams(least_run=4, least_share=rng.choice([0.01, 0.4]))
    menu, foot = [1, 2, 3, 4, 5], [6, 7]
    docs = []
    for _ in range(9):
        own = [rng.randrange(100, 10000) for _ in range(rng.randrange(0, 25))]
        docs.append(rng.choice([menu, []]) + own + rng.choice([foot, menu, []]))
    docs += [docs[0], docs[3], []]  # copies alone repeat nothing
    tokens = np.array([x for d in docs for x in d], np.int64)
    page = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = pages.covered(tokens, page, len(docs), p).tolist()
    assert got == [x for d in plain_covered(docs, p) for x in d]


class Reader(HTMLParser):
    """Text of well-formed articles, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "li", "ul", "article"):
            self.out.append("")
        if tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "li", "ul", "article"):
            self.out.append("")

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data


def test_blocks_against_a_standard_parser():
    rng = random.Random(1)
    for _ in range(80):
        body = "".join(rng.choice(["<p>%s</p>", "<h1>%s</h1>", "<ul><li>%s</li></ul>", "<p><b>%s", "\n %s<br>", "<p class=x>%s"])
                       % " ".join(rng.choice(["a", "&amp;", "&eacute;t", "&#x41;", "&lt;b&gt;", "x &nbsp; y", "<i>z</i>q", "&am", "\t", "é"]) for _ in range(9))
                       for _ in range(rng.randrange(6)))
        page = f"<html><head><title>t</title></head><body><nav><p>menu</p></nav><article>{body}</article><footer>f</footer></body>"
        r = Reader()
        r.feed(page)
        r.close()
        want = [" ".join(x.split()) for x in r.out if x.strip()]
        texts, kinds = mainblocks.blocks(page)
        assert [t for t, k in zip(texts, kinds) if k == "A"] == want
        assert [t for t, k in zip(texts, kinds) if k != "A"] == ["menu", "f"]


@pytest.mark.parametrize("html,want", [
    ("", []),
    ("plain & text", [("U", "plain & text")]),
    ("<main>m<article>a</article>n</main>u", [("M", "m"), ("A", "a"), ("M", "n"), ("U", "u")]),
    ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer><aside>s</aside></article>", [("A", "T"), ("A", "x"), ("C", "f"), ("C", "s")]),
    ("<header>h</header><article>a</article>", [("C", "h"), ("A", "a")]),
    ("<article><p>one <span class=ad>buy</span> two</p></article>", [("A", "one two"), ("C", "buy")]),
    ("<article>a<div class='cookie-notice'>c<div>d</div></div>b</article>", [("A", "a"), ("C", "c"), ("C", "d"), ("A", "b")]),
    ("<section id=comments><article class=comment><p>c</p></article></section>", [("C", "c")]),
    ("<nav>x<article>a</article>", [("C", "x"), ("A", "a")]),
    ("<form id=all><article>a</article></form>", [("A", "a")]),
    ("<body class='has-cookie'><div class='layout with-sidebar'><article>a</article></div>", [("A", "a")]),
    ("<article>a<script>var t = '</p>';<!-- </script>b<!-- c -->d<style>p{}</style></article>", [("A", "abd")]),
    ("<article>a<p hidden>h</p><p style='display: none'>n</p><p>b", [("A", "a"), ("C", "h"), ("C", "n"), ("A", "b")]),
    ("<ARTICLE><P TITLE='a > b'>x</P></ARTICLE><SCRIPT>never closed", [("A", "x")]),
    ("<article><p>a < b and c<d</p></article>", [("A", "a < b and c")]),
    ("<article><label class=ad>x</label><button>go</button>y</article>", [("A", "y"), ("C", "xgo")]),
])
def test_blocks(html, want):
    texts, kinds = mainblocks.blocks(html)
    assert list(zip(kinds, texts)) == want


def site(seed, n=30):
    """Pages of one host without any telling markup, and their main texts."""
    rng = random.Random(seed)

    def say(k):
        return " ".join(f"w{rng.randrange(50000)}" for _ in range(k))
    menu, foot, note = [say(2) for _ in range(6)], say(12), say(10)
    out = []
    for i in range(n):
        paragraphs = [say(rng.randrange(9, 40)) for _ in range(rng.randrange(1, 6))]
        html = "<html><body><div>" + "".join(f"<span>{m} </span>" for m in menu) + "</div>" + \
            "".join(f"<div>{x}</div>" for x in paragraphs) + (f"<p>{note}</p>" if i % 3 == 0 else "") + f"<div>{foot}</div></body></html>"
        out.append((html, "\n".join(paragraphs)))
    return out


def test_sites_without_markup(spark):
    made = site(1)
    rows = [(i, f"http://a.example.com/{i}", h) for i, (h, _) in enumerate(made)] + [(100, "http://a.example.com/copy", made[4][0])]
    rows += [(200, None, None), (201, "no scheme", ""), (None, "http://b.org", "<p>" + "long " * 200000 + "</p>"), (None, "http://b.org", "<p>x")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in [*CLASHING, "part", "parts", "big", "blocks", "kinds"]})
    got = {(r.page_id, r.url): r for r in pages.main_text(df).collect() if r.page_id is not None}
    for i, (_, text) in enumerate(made):
        r = got[i, f"http://a.example.com/{i}"]
        assert r.text == text and r.n_chars == len(text) and r.n_repeated >= 24
    assert got[100, "http://a.example.com/copy"].text == made[4][1]
    assert got[200, None].text == got[201, "no scheme"].text == ""
    assert sorted(r.n_chars for r in pages.main_text(df).where("page_id is null").collect()) == [1, 999999]


def test_articles_keep_what_repeats(spark):
    same = "<p>" + " ".join(f"q{i}" for i in range(30)) + "</p>"
    rows = [(i, "https://X.example/%d" % i, f"<nav>m{i}</nav><article><h1>t{i}</h1>{same}</article><div>share this page with all your friends today</div>")
            for i in range(12)]
    for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect():
        assert r.text == f"t{r.page_id}\n" + same[3:-4] and r.n_repeated >= 8 and r.n_named == 1


@pytest.mark.parametrize("sent", [0, 10])
def test_parts_of_a_big_host(spark, sent):
    made = site(2, 200)
    rows = [(i, f"http://h.example/{i}", h) for i, (h, _) in enumerate(made)]
    p = pages.PageParams(part_bytes=sum(len(h) for h, _ in made) // 4, most_sent=sent)
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, PAGES), params=p).collect()}
    assert got == {i: t for i, (_, t) in enumerate(made)}


def test_empty_table(spark):
    assert pages.main_text(spark.createDataFrame([], PAGES)).collect() == []


def shared_site(n=240):
    """Pages of one host, unmarked: a banner on all, lines that only a few pages share, copies, empty pages."""
    rng = random.Random(7)

    def say(k):
        return " ".join(f"w{rng.randrange(50000)}" for _ in range(k))
    banner, lines = say(10), [say(10) for _ in range(40)]
    htmls = [f"<div>{banner}</div><p>{say(rng.randrange(9, 30))}</p>" + "".join(f"<p>{x}</p>" for j, x in enumerate(lines) if i % (j * 3 + 40) < 2)
             for i in range(n)]
    return htmls + htmls[:60] * 2 + ["", "<p>a"] * 3 + ["<p>" + "la " * n for n in (20, 30, 40)]


@pytest.mark.parametrize("sent", [0, 10])
@pytest.mark.parametrize("share", [0.01, 0.03])
def test_parts_do_not_change_the_result(spark, share, sent):
    htmls = shared_site()
    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)] + [(i, f"http://small.example/{i}", h) for i, h in enumerate(htmls[:5])]
    rows += [rows[0], (None, "http://h.example/", htmls[3]), (None, "http://h.example/", None)]
    df = spark.createDataFrame(rows, PAGES)
    total = sum(len(h) for h in htmls)
    got = [sorted(map(str, pages.main_text(df, params=pages.PageParams(part_bytes=b, least_share=share, most_sent=sent)).collect()))
           for b in (10 * total, total // 3, total // 50)]
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == len(rows)


def test_a_line_of_two_parts_is_found(spark):
    """Two pages share a line: it repeats on the host wherever the pages lie."""
    rng = random.Random(3)

    def say(k):
        return " ".join(f"w{rng.randrange(50000)}" for _ in range(k))
    line = say(12)
    own = [say(20) for _ in range(40)]
    rows = [(i, f"http://h.example/{i}", f"<p>{x}</p>" + (f"<p>{line}</p>" if i < 2 else "")) for i, x in enumerate(own)]
    for part_bytes in (1 << 20, 700, 200):
        got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, PAGES), params=pages.PageParams(part_bytes=part_bytes)).collect()}
        assert {i: r.text for i, r in got.items()} == dict(enumerate(own))
        assert {i for i, r in got.items() if r.n_repeated == 12} == {0, 1}


def test_window_hashes_are_of_the_words():
    hashes = np.array([5, 6, 7, 5, 6, 7, 5, 6], np.uint64)
    page = np.array([0, 0, 0, 1, 1, 1, 3, 3])
    x = pages.stream(page, 4, 4)
    h = pages.window_hashes(x, hashes, 4)
    of = x.of[x.windows]
    assert h[of == 0].tolist() == h[of == 1].tolist() and len(set(h[of == 0])) == 6
    assert len(set(h[of == 3])) == 5 and not (of == 2).any()
    c = pages.contents(x, h)
    assert c[0] == c[1] and len(set(c)) == 3
