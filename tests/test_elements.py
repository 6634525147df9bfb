"""Page fields by element."""

import pytest

from qalake.sources.elements import ARTICLE_FIELDS, Field, element_fields, page_fields

ARTICLE = """<!DOCTYPE html><HTML><body>
<header id="full-view-heading"><DIV class="article-citation wide"><div class="article-source">
<button id="full-view-journal-trigger" title="J Test &amp; Co">JT</button><span class="cit">2019 Mar;3(1)</span></div></div>
<h1>
  A <i>title</i> &lt;here&gt; </h1></header>
<div id="eng-abstract"><p> <strong>Aim:</strong> one.<p>Two<script>var x = "</p>";</script> more.</p><div><p>not a child</p></div></div>
<div id="mesh-terms"><ul><li><div><button>Heart* / surgery</button></div><li><div><button> LIVER </button></div></ul>
<ol><li><div><button>outside</button></div></ol></div></body></html>"""


def test_article_fields():
    assert page_fields(ARTICLE, ARTICLE_FIELDS) == [
        "J Test & Co", ["heart* / surgery", "liver"], "2019", "Aim:one.Twomore.", "Atitle<here>"]
    assert page_fields(None, ARTICLE_FIELDS) == [None, [], None, "", None]


def test_paths_and_broken_markup():
    f = [Field("a", "div p", many=True), Field("b", "div > p", many=True), Field("c", "p.x.y", many=True), Field("d", "*#k", many=True)]
    assert page_fields("<div><section><p class='y x z'>1</section><p id=k>2<div>3</div>4</div></p><p>5", f) == [
        ["1", "2"], ["2"], ["1"], ["2"]]
    assert page_fields("<div><p>a<b>c</div></b><p>out<![weird[x]]></div>", f)[0] == ["ac"]
    assert page_fields("<ul><li>1<ul><li>2</ul><li>3</ul>", [Field("l", "ul > li", many=True)]) == [["12", "2", "3"]]
    for bad in ("", "a + b", ">"):
        with pytest.raises(ValueError):
            page_fields("", [Field("x", bad)])


def test_element_fields_frame(spark):
    df = spark.createDataFrame([(1, ARTICLE, "u"), (2, None, "v"), (2, "", None)], "page_id long, html string, url string")
    out = element_fields(df)
    assert out.columns == ["page_id", "url", "journal", "mesh_major", "year", "abstract", "title"]
    rows = {(r.page_id, r.url): r for r in out.collect()}
    assert len(rows) == 3 and rows[1, "u"].year == "2019" and rows[2, "v"].mesh_major == [] and rows[2, None].title is None
    assert element_fields(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        element_fields(df, [Field("URL", "a")])


def test_long_page_is_linear():
    import time
    def took(n):
        t0 = time.perf_counter()
        assert len(page_fields("<div>" + "<p>w <b>x</b>" * n + "</div>", [Field("p", "div > p", many=True)])[0]) == n
        return time.perf_counter() - t0
    took(1000)
    assert took(80_000) < 10 * took(20_000) + 0.5
