"""Rendering against expected texts, and all pages against an independent word count."""

import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from fogon.llm.html_text import extract, render

CASES = {
    "blocks": ("<h1>A</h1><p>b <b>c</b>\n d<p>e<br>f<div>g</div>h", "A\n\nb c d\n\ne\nf\n\ng\nh"),
    "implied cells": ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>x", "a   bbb\ncc  d\n\nx"),
    "cell without row": ("<table><td>a<td>b</table>", "a  b"),
    "spans": (
        "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>ff gg hh<td>i</table>",
        "a  b      c\n   d      e\nff gg hh  i",
    ),
    "lists": (
        "<ul><li>a<li>b<ol start=9><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  9. c\n  10. d\n- e",
    ),
    "multi-line cell": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "unseen": (
        "<head><title>t</title></head><script>var a='<p>x</p>'</script><style>.h,#k{display:none} i{visibility:hidden}</style>"
        "<p hidden>1</p><p style='display: none'>2</p><p class='z h'>3</p><p id=k>4</p><i>5<b style='visibility:visible'>6</b></i>"
        "<template>7</template><!-- 8 --><noscript>9</noscript><input type=hidden value=10><p>end",
        "6\n\nend",
    ),
    "details": ("<details><summary>s</summary>x<p>y</details><details open><summary>t</summary>z</details>", "s\nt\nz"),
    "pre": ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    "entities": ("a &amp; b&nbsp;c &copy &lt;p>", "a & b\xa0c © <p>"),
    "truncated": ("<p>a</p><p>b <a href='x", "a\n\nb"),
    "stray end tags": ("a</div></b> b</p>c", "a b\n\nc"),
    "quote and definition": ("<blockquote>a<br>b</blockquote><dl><dt>t<dd>d</dl>", "  a\n  b\n\nt\n  d"),
    "alt and button": ("a<img alt='pic'>b<input type=submit value=Go>", "a pic b Go"),
    "wide characters": ("<table><tr><td>日本<td>x<tr><td>a<td>y</table>", "日本  x\na     y"),
    "less-than": ("1 < 2 and 3<4", "1 < 2 and 3<4"),
    "quote in a bare value": ("<p class=it's>Hello</p> <b>don't</b> stop", "Hello\n\ndon't stop"),
    "quote behind a value": ('<a href="x"">hello</a> world', "hello world"),
    "mark in a value": ("<a title='>' b=\">\" c = '>'>x</a title='>'>y", "xy"),
    "empty comments": ("<!-->shown--> <!--->end", "shown--> end"),
    "no end tags": ("x </3 y> z </> w </", "x z w </"),
    "xmp and plaintext": ("<xmp>a <b> &amp;</xmp>c<plaintext>d<e>", "a <b> &amp;\n\nc\n\nd<e>"),
    "long word in a cell": ("<table><tr><td>" + "x" * 70 + "<td>b<tr><td>c<td>d</table>", "x" * 70 + "  b\nc" + " " * 61 + "d"),
    "wrapped cell": (
        "<table><tr><td>" + "word " * 15 + "<td>b</table>", "word " * 11 + "word  b\n" + "word word word",
    ),
    "verbatim cell": ("<table><tr><td><pre>" + "a " * 40 + "z</pre><td>b</table>", "a " * 40 + "z  b"),
    "spans below spans": (
        "<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e<td>f</table>", "a  b  c\n      d\n   e  f",
    ),
    "nothing": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    html, text = CASES[name]
    assert render(html) == text


def test_depth_and_length():
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<b><table><tr><td>" * 300 + "x").strip() == "x"
    assert len(render("<p>word " * 100_000).split()) == 100_000


class _Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, Counter()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("title", "script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("title", "script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.words.update("".join(data.split()))


def test_all_pages_keep_their_visible_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in extract(pages).collect()}
    for row in pages.collect():
        plain = _Words()
        plain.feed(row.html)
        plain.close()
        got = Counter("".join(texts[row.page_id].split()))
        got["-"] -= row.html.count("<li>")  # list markers
        assert +got == +plain.words, row.page_id


def test_rows_of_any_kind(spark):
    frame = spark.createDataFrame(
        [(1, "u", "<p>a", "x"), (None, None, None, "y"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, text string"
    )
    assert sorted(extract(frame).collect(), key=str) == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, "")], key=str)
    assert extract(frame.limit(0)).collect() == []


SHEETS = {
    "print": ("@media print { .x{display:none} p{display:none} }", "", True),
    "not print": ("@media not print{.x{display:none}}", "", False),
    "screen": ("@media screen, print { .x{display:none} }", "", False),
    "narrow screen": ("@media (max-width:600px){.x{display:none}}", "", True),
    "wide screen shows": (".x{display:none} @media screen and (min-width:600px){.x{display:block}}", "", True),
    "rule after a block": ("@import 'a{'; @media print{.y{color:red}} .x{display:none}", "", False),
    "font and frames": ("@font-face{src:url(a)} @keyframes k{from{display:none} to{color:red}} .x{display:none}", "", False),
    "later rule": (".x{display:none} .x{display:block}", "", True),
    "later rule hides": (".x{display:flex} .x{display:none}", "", False),
    "id before class": ("#i{display:block} .x{display:none}", "", True),
    "important": (".x{display:none !important} #i{display:block}", "", False),
    "inline": (".x{display:none}", "style='display:block'", True),
    "inline hides": (".x{display:block}", "style='display:none'", False),
    "inline against important": (".x{display:none!important}", "style='display:block'", False),
    "visibility alone": (".x{visibility:hidden} .x{display:block}", "", False),
    "hidden attribute": (".x{display:block}", "hidden", True),
}


@pytest.mark.parametrize("name", SHEETS)
def test_cascade(name):
    sheet, attribute, shown = SHEETS[name]
    assert render(f"<style>{sheet}</style>a<p class=x id=i {attribute}>b</p>") == ("a\n\nb" if shown else "a")


def test_style_element_for_print():
    assert render("<style media=print>p{display:none}</style><p>a") == "a"
    assert render("<style media='screen'>p{display:none}</style>b<p>a") == "b"


def test_svg_and_math():
    svg = "<svg><title>t</title><defs><text>d</text></defs><path d=''/><text>one</text><g><text x=1>two <tspan>three</tspan></text></g><desc/></svg>"
    assert render(f"<p>a {svg} b") == "a one two three b"
    assert render("<svg><title/><text>one</text></svg><p>b") == "one\n\nb"
    math = "<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></semantics></math>"
    assert render(f"<p>a {math} b") == "a x=1 b"


def plain_text(page):
    """Text of a page of inline tags by the states of the standard's tokenizer, a character at a time."""
    state, out, i, quote = "data", [], 0, ""
    while i < len(page):
        c = page[i]
        if state == "data":
            if c == "<" and (page[i + 1 : i + 2].isalpha() or page[i + 1 : i + 2] == "/" and page[i + 2 : i + 3].isalpha()):
                state = "tag"
                i += page[i + 1] == "/"
            elif c == "<" and page[i + 1 : i + 2] == "/" and i + 2 < len(page) or c == "<" and page[i + 1 : i + 2] in ("!", "?"):
                state = "bogus"
                i += 1
                if page[i : i + 3] == "!--":
                    state = "comment"
                    i += 2
                    if page[i + 1 : i + 2] == ">" or page[i + 1 : i + 3] == "->":
                        i = page.index(">", i)
                        state = "data"
            else:
                out.append(c)
        elif state == "bogus":
            state = "data" if c == ">" else state
        elif state == "comment":
            if page.startswith("-->", i) or page.startswith("--!>", i):
                i = page.index(">", i)
                state = "data"
        elif state == "quoted":
            state = "before name" if c == quote else state
        elif c == ">":
            state = "data"
        elif state == "tag":
            state = "before name" if c in " /" else state
        elif state == "before name":
            state = state if c in " /" else "name"
        elif state == "name":
            state = "after name" if c == " " else "before name" if c == "/" else "before value" if c == "=" else state
        elif state == "after name":
            state = "before value" if c == "=" else state if c == " " else "before name" if c == "/" else "name"
        elif state == "before value":
            if c in "'\"":
                state, quote = "quoted", c
            elif c != " ":
                state = "bare"
        elif state == "bare":
            state = "before name" if c == " " else state
        i += 1
    return "".join(out)


def test_random_tags_against_the_states_of_the_standard():
    rng = random.Random(5)
    parts = ["<", ">", "</", "/", "=", "'", '"', " ", "b", "i", "x", "<b", "</i>", "<!--", "-->", "--!>", "<!", "<b a=", "-", "?", "3"]
    for _ in range(30_000):
        page = "".join(rng.choices(parts, k=rng.randrange(1, 16)))
        assert "".join(render(page).split()) == "".join(plain_text(page).split()), page


@pytest.mark.parametrize(
    "page",
    [
        "<table>" + "<tr><td>" + "word " * 20_000 + "<td>end" + "<tr><td>a<td>b" * 2000,
        "<table>" + "<tr><td>" + "w" * 100_000 + "<td>end" + "<tr><td>a<td>b" * 2000,
        "<table>" + "<tr><td rowspan=65534 colspan=1000>a<td>b" * 2000,
        "<style>" + "".join(f".c{i}{{display:none}} .x{{display:block}}" for i in range(3000)) + "</style>" + "<p class='x y'>a</p>" * 5000,
        "<ul><li>a" * 10_000,
        "<table><tr><td>a<td>" * 2000,
        "<a " + "x='" * 50_000,
        "<a b" + " " * 100_000 + "c>d" + "<a " * 50_000,
    ],
    ids=["cell", "word", "spans", "rules", "lists", "tables", "quotes", "blanks"],
)
def test_large_pages_take_little_time_and_room(page):
    begin = time.perf_counter()
    assert len(render(page)) < 1_000_000
    assert time.perf_counter() - begin < 5
