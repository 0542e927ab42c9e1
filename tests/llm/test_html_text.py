import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clonalis.llm import html_text as ht


def text(page):
    return ht.render(page)[0]


CASES = [
    ("", ""),
    ("plain &amp; simple &lt;b&gt;", "plain & simple <b>"),
    ("a  b\n c<b> d</b>e", "a b c de"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<h1>T</h1>x<div>y</div>z", "T\n\nx\ny\nz"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "* a\n* b\n\n  * c\n* d\n\ne"),
    ("<ol start=3><li>a<li value=9>b<p>more<li>c</ol>", "3. a\n9. b\n\n   more\n10. c"),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n    v\nl\n    w"),
    ("<table><tr><th>Name<th>n<tr><td>apple<td>10<tr><td>fig<td>2</table>", "Name   n\napple  10\nfig    2"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table>stray<tr><td>x</table>", "stray\n\nx"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>", "wide one  z\na  b  c"),
    ("<table><tr><td>l1<br>l2<td>m</table>", "l1  m\nl2"),
    ("<pre>\n a\n\tb  c</pre>", " a\n        b  c"),
    ("<head><title> A  &eacute; </title><style>p{x}</style><p>in body", "in body"),
    ("<script>var t='</p>'<b>;</script>x<style>y</style><!-- z --><noscript>n</noscript>", "x"),
    ("<div hidden>a</div><p style='display : NONE'>b</p><span style='visibility:hidden'>c</span>d", "d"),
    ("<style>.x, #y{display:none} b.z{visibility:hidden}</style><i class='w x'>1</i><i id=y>2</i><b class=z>3</b><i class=z>4</i>", "4"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<p>a</div>b</p></p>c", "ab\n\nc"),
    ("a < b <3 </ x> <!doctype html> <?php ?>c", "a < b <3 c"),
    ("<a title='x>y' href=\"u\">k</a><b x=\"unclosed>z", "kz"),
    ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
    ("<textarea>\n a <b></textarea>", " a <b>"),
    ("&nbsp;x&nbsp;&nbsp;y", " x  y"),
    ("<ul><li></ul>", "*"),
    ("<p>never closed", "never closed"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert text(page) == want


def test_title():
    assert ht.render("<html><head><title>A &amp;\n b</title></head><body>x")[1] == "A & b"
    assert ht.render("x")[1] is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <b> </b> <table> </table> <tr> <td> </td> <ul> </ul> <li> <div> </div> <pre> </pre> <br> <dl> <dd> <h1> </h2> <form> <a> </table".split()) | st.sampled_from(["w1", "w2 ", "\n", "é", "&amp;"]), max_size=40))
def test_no_word_is_lost(parts):
    page = "".join(parts)
    plain = re.sub(r"<[^>]*>|<[^>]*\Z", " ", page)
    words = lambda t: sorted(re.findall(r"w1|w2|é|&", t.replace("&amp;", "&")))
    assert words(text(page)) == words(plain)


@pytest.mark.parametrize("page", ["<div>" * 30000 + "x", "<table><tr><td>" * 3000 + "x", "<a b=" * 20000 + "x", "<!--" * 20000, "<" * 50000, "<table>" + "<b>x" * 3000])
def test_odd_and_long_pages(page):
    text(page)


def test_documents(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "<p>a<p>b", 0), (3, "<p>a<p>b", 0), (None, "<title>t</title>x" + "<p>long " * 20000, 0)], "page_id long, html string, text int")
    rows = sorted(ht.extract_text(d).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.n_lines) for r in rows] == [(None, 40001), (1, 0), (2, 0), (3, 3), (3, 3)]
    assert rows[1].text == "" and rows[1].title is None and rows[0].title == "t"
    assert ht.extract_text(d.limit(0)).count() == 0


def test_pages_against_plain_stripping(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in ht.extract_text(pages).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", " ", raw[r.page_id])
        plain = re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?(b|a)\b", m[0]) else " ", body)
        import html

        assert r.text.replace("* ", " ").split() == html.unescape(plain).replace("* ", " ").split()


@pytest.mark.parametrize("page,want", [
    ("<style>@media print{.nav{display:none}}</style><p class=nav>a", "a"),
    ("<style>@media (max-width:600px){.side{display:none}} .x{display:none}</style><p class=side>a<p class=x>b", "a"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>@media screen{.x{display:none}} @layer a{.y{display:none}}</style><i class=x>a</i><i class=y>b</i>c", "c"),
    ("<style>@import 'a;{b'; @font-face{x:y} .x{display:none}</style><i class=x>a</i>b", "b"),
    ("<style>.x{display:none} .x{display:block}</style><p class=x>a", "a"),
    ("<style>.x{display:block} .x{display:none}</style><p class=x>a", ""),
    ("<style>p.x{display:block} .x{display:none}</style><p class=x>a", "a"),
    ("<style>.x{display:none} .page > .x{display:block}</style><div class=page><p class=x>a</div><p class=x>b", "a"),
    ("<style>.x{display:none} @media (min-width:600px){.x{display:block}}</style><p class=x>a", "a"),
    ("<style>.x{display:none} @media print{.x{display:block}}</style><p class=x>a", ""),
    ("<style>.x{display:none !important} .x{display:block}</style><p class=x style='display:block'>a", ""),
    ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>c", "b\nc"),
    ("<style>.x{display:none", ""),
    ("<svg><title>t</title><desc>d</desc><defs><text>e</text></defs><path d='M1'/><text>a</text><text>b</text></svg>c", "a b c"),
    ("<svg><defs/><text>a</text></svg><p>b", "a\n\nb"),
    ("<svg><defs><path><p>b", "b"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("<desc>a</desc>", "a"),
])
def test_what_is_shown(page, want):
    assert text(page) == want


@pytest.mark.parametrize("above", range(180, 205))
def test_cells_at_the_depth_limit(above):
    page = "<div>" * above + "<table><tr><td>w1<b>w2</b><i>w3</i><td><p>w4</p>w5</table>"
    assert sorted(re.findall(r"w\d", text(page))) == ["w1", "w2", "w3", "w4", "w5"]


@pytest.mark.parametrize("depth", [0, 10, 190, 250, 20_000])
def test_hidden_content_at_any_depth(depth):
    page = "<div>" * depth + "<div hidden><p>SECRET<span>IN</p>more</div>" + "<p>seen<b> too</b><ul><li>one<li>two</ul>" + "</div>" * depth + "<p>after"
    text = ht.render(page)[0]
    assert "SECRET" not in text and "IN" not in text and "more" not in text
    assert text.split() == ["seen", "too", *(["*", "one", "*", "two"] if depth < 170 else ["one", "two"]), "after"]
    lines = [x for x in text.split("\n") if x]
    assert lines[0] == "seen too" and lines[-1] == "after"


def test_long_cells_keep_the_columns():
    page = "<table><tr><td>a<td>b<td>c<tr><td>" + "w" * 500 + "<td>x<td>y<tr><td>dd<td>e<td>f</table>"
    lines = ht.render(page)[0].split("\n")
    assert lines == ["a   b  c", "w" * 500, "    x  y", "dd  e  f"]
