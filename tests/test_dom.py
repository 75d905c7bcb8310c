"""Element trees, sections and edits of single pages."""

import time

import pytest

from crawlsight.operators import dom
from crawlsight.operators import extract as X


def paths(source):
    page = dom.Page(source)
    return [page.path(e) for e in page.elements]


def test_end_tags_that_are_left_out():
    assert paths("<div><p>a<p>b<b>c<div>d</div></div><p>e") == ["div[1]", "div[1]/p[1]", "div[1]/p[2]", "div[1]/p[2]/b[1]", "div[1]/div[1]", "p[1]"]
    assert paths("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["ul[1]", "ul[1]/li[1]", "ul[1]/li[1]/ul[1]", "ul[1]/li[1]/ul[1]/li[1]", "ul[1]/li[1]/ul[1]/li[2]", "ul[1]/li[2]"]
    assert paths("<table><tr><td>1<td>2<tr><th>3</table><p>") == ["table[1]", "table[1]/tr[1]", "table[1]/tr[1]/td[1]", "table[1]/tr[1]/td[2]", "table[1]/tr[2]", "table[1]/tr[2]/th[1]", "p[1]"]
    assert paths("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>") == ["dl[1]", "dl[1]/dt[1]", "dl[1]/dd[1]", "dl[1]/dt[2]", "select[1]", "select[1]/option[1]", "select[1]/option[2]"]
    assert paths("<p>a</b></i>b</p></p><br/><img><p>c") == ["p[1]", "br[1]", "img[1]", "p[2]"]
    assert paths("<P>x</P><!-- <p> --><script>'<p>'</script><style>p{}</style>") == ["p[1]", "script[1]", "style[1]"]
    assert paths("") == paths(None) == paths("text < more") == []


def test_places_and_attributes():
    source = "<a  HREF='x?a&amp;b' href=y\n data-k>t &lt;</a>"
    (a,) = dom.Page(source).elements
    assert a.attrs == {"href": "x?a&b", "data-k": ""} and source[a.start : a.stop] == source and source[a.inside : a.end] == "t &lt;"
    assert dom.Page(source).text_of(a) == "t <"


def sections(source):
    return [(e.tag, n) for e, n in dom.Page(source).sections()]


def test_sections_end_with_the_next_heading_or_the_parent():
    assert sections("<div><h2>a</h2>loose <p>one two</p> <p>three</p><h3>b</h3><ul><li>x y</ul></div><p>after") == [("h2", 2), ("h3", 2)]
    assert sections("<div><h2>a</h2><p>one two<p>three</div><p>not counted") == [("h2", 2)]
    assert sections("<h2>a</h2><div>k <h2>inner</h2><p>l</p></div>") == [("h2", 2), ("h2", 1)]


def test_the_page_rules_end_paragraphs_too(spark):
    rows = [(1, "<body><div><h2>a</h2><p>one two<p>three</div><p>four five six</body>"), (2, "<body><div><h2>a</h2><p>one <b>two<div>three</div></div><p>four</p></body>"), (3, "<body><h2>a</h2><p>one</p><h3>b</h3><p>two <i>three</i></p></body>")]
    words = {1: [3], 2: [3], 3: [1, 2]}
    df = spark.createDataFrame([(i, t.replace("<h2>a", "<h2>z</h2><h2>a")) for i, t in rows], "page_id long, body string")
    got = {r["page_id"]: r["w"] for r in df.select("page_id", X.section_words(df["body"]).alias("w")).collect()}
    assert got == {i: [0, *w] for i, w in words.items()}


def repaired(source, url="https://x.example.com/a/b"):
    return dom.repairs(dom.Page(source), url).applied()


def test_edits_are_put_in_place_once():
    whole = '<!DOCTYPE html><html><head><script src="a.js"></script><link rel=canonical href=../c></head><body><h1>A</h1><h1 class="k">B</h1><h4>C</h4>'
    whole += '<img src="1"><img src="2"><img src="3"/><a target=_blank href="/x">x</a><div onclick="f()">d</div><a href="/my-page.html">Click here</a></body></html>'
    out = repaired(whole)
    assert '<html lang="en"><head><meta charset="utf-8"><script src="a.js" defer></script><link rel=canonical href="https://x.example.com/c">' in out
    assert '<h1>A</h1><h2 class="k">B</h2><h3>C</h3><img src="1"><img src="2"><img src="3" loading="lazy"/>' in out
    assert '<a target=_blank href="/x" rel="noopener noreferrer">x</a><div onclick="f()" role="button" tabindex="0">d</div><a href="/my-page.html">My Page</a>' in out
    assert out.index('<meta property="og:url"') < out.index("</head>") and repaired(out) == out


@pytest.mark.parametrize("source", ["", "no tags", "<body>only a body</body>", "<html><p>x</html>"])
def test_pages_without_a_head(source):
    out = repaired(source)
    assert '<meta charset="utf-8">' in out and repaired(out).count("canonical") == 1


@pytest.mark.parametrize("unit", ["<p>", "<b>", "<li>x", "<div>", "</div>", "<", "<a href=", '"', "<!--", "<img src=x alt=y>"])
def test_long_pages_take_linear_time(unit):
    def run(n):
        began = time.process_time()
        page = dom.Page(unit * n)
        dom.findings(page), dom.repairs(page, "https://x.example.com/").applied(), page.sections()
        return time.process_time() - began

    run(200)
    assert run(4000) < 10 * (run(1000) + 0.02)


def test_rows_of_pages(spark):
    pages = spark.createDataFrame([(1, "https://x.example.com/", '<label>a <input name="k"></label><input><h2>t</h2><p>u v'), (2, None, None)], "page_id long, url string, html string").withColumn("node", X.F.lit(1))
    assert [tuple(r) for r in dom.form_fields(pages).collect()] == [(1, 9, "input", "", "k", True), (1, 33, "input", "", "", False)]
    assert {r["path"] for r in dom.elements(pages).collect()} == {"label[1]", "label[1]/input[1]", "input[1]", "h2[1]", "p[1]"}
    assert [tuple(r) for r in dom.sections(pages).collect()] == [(1, 0, "h2", 40, 2)]
    assert {r["rule_id"] for r in dom.annotations(pages).filter("page_id = 2").collect()} >= {"title-missing", "h1-missing"}
    assert dom.repaired(pages).count() == 2 and dom.annotations(pages.limit(0)).collect() == []
