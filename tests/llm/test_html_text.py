from __future__ import annotations

import re
import time
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pytest

from pricewren.llm import html_text, queries
from tests.llm.making import SF_DIR


class Words(HTMLParser):
    """Words outside of elements that are never shown: a plainer reading of what a page says."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "noscript", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "noscript", "template") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out += data.split()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One<p>Two", "One\n\nTwo"),
        ("<div>a</div><div>b <b>c</b></div>", "a\nb c"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
        ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
        ("<table><tr><th>a<th>bcd<tr><td>long one<td>2</table>", "a         bcd\nlong one  2"),
        ("x<span hidden>no</span> <i style='display: none'>no</i>y<script>no()</script>", "x y"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>", "yes"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("a&amp;b<br>c", "a&b\nc"),
        ("<details><summary>s</summary>no</details>", "s"),
        ("text only", "text only"),
        ("", ""),
        (None, ""),
        ("<![foo[x]]>after", "after"),
        ("<p>open <b>bold</p>next", "open bold\n\nnext"),
        ("<html><head><title>T</title><p>Hello<div>World</div>", "Hello\n\nWorld"),
        ("<head> <meta charset=utf-8> <title>T</title> <style>s</style> text <b>bold</b>", "text bold"),
        ("<head><title>T</title><noscript><style>s</style></noscript></head>after", "after"),
    ],
)
def test_rendering(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a <svg><title>t</title><desc>d</desc><defs><text>no</text></defs><rect/><text>Label</text><text>Two</text></svg> b", "a\nLabel\nTwo\nb"),
        ("x<svg><defs/><text>Label</text></svg>", "x\nLabel"),
        ("is <math><mfrac><mi>a</mi><mn>2</mn></mfrac><mo>+</mo><mi>b</mi><annotation>no</annotation></math> so", "is a 2+b so"),
        ("<span aria-hidden=true>shown</span> too", "shown too"),
        ("<svg><text style='display: none'>no</text></svg>yes", "yes"),
    ],
)
def test_drawings_formulas_and_marks(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<script>no()</script>a", "a"),
        ("<b hidden>no <i>no</i></b>a", "a"),
        ("<b style='visibility: hidden'>no <i style='visibility: visible'>a</i></b>", "a"),
        ("<details>no<summary>a</summary>no<b>no</b></details>", "a"),
        ("<p>a</p>b", "a\nb"),
        ("<svg><title>no</title><text>a</text></svg>", "a"),
    ],
)
def test_deep_elements_are_hidden_and_closed(inner, text):
    for deep in (195, 199, 201, 400):
        html = "<section hidden></section><ul><li>x " + "<span>" * deep + inner + "</span>" * deep + "</ul>end"
        assert html_text.visible_text(html).split() == ["-", "x", *text.split(), "end"], deep


def test_deep_and_long_pages():
    assert "end" in html_text.visible_text("<div>" * 5000 + "end")
    assert len(html_text.visible_text("<p>word</p>" * 20_000).split()) == 20_000


def test_query_keeps_all_words(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = queries.op3_html_extraction(spark, SF_DIR).collect()
    assert len(found) == len(pages)
    for r in found:
        words = Words()
        words.feed(pages[r["page_id"]])
        words.close()
        whole = re.sub(r"\s", "", r["text"])
        assert [w for w in set(words.out) if w not in whole] == []


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(rows).collect()) == [(0, "x"), (1, ""), (2, ""), (2, "")]
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<a href='x>y' title=\"a'b\">link</a> rest", "link rest"),
        ("a<!-- no > --> b <!--> c <!---> d <!-- no --!> e", "a b c d e"),
        ("<!doctype html><?xml no?>a </ no>b", "a b"),
        ("1 < 2 <3 << 4<", "1 < 2 <3 << 4<"),
        ("<textarea>a <b>&amp; c</textarea>d", "a <b>& cd"),
        ("<script>if (a </scripty b) '</p>' </SCRIPT >a<style></style>b", "ab"),
        ("a<script>no", "a"),
        ("a<b title='no", "a"),
        ("a<b no", "a"),
        ("a</b no", "a"),
        ("<svg><text><![CDATA[a<b]]></text></svg><![CDATA[no]]>c", "a<b\nc"),
        ("<p/>a<br/>b<td/>c", "a\nbc"),
        ("<p hidden hidden=x>no<p style=a style='display:none'>yes", "yes"),
        ("<table><tr><td colspan=2>wide cell<td>c<tr><td>1<td>2<td>3</table>", "wide cell" + "  c\n1  2  3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>a<br>bb<td>c<br>d<br>e</table>", "a   c\nbb  d\n    e"),
    ],
)
def test_scanner_and_tables(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize(
    "part",
    ["<a ", "<", "</", "<!--", "<a b='", "<div>", "<p><b>", "<table>", "<table><tr><td>", "<blockquote>", "<ul><li>", "<td>x", "<svg>", "<script>", "</p>", "&amp", "<a <b>", "<title>", "<li>x", "<button><p><span>", "<h1>", "<details>", "<option>"],
)
def test_time_grows_with_length(part):
    """Hostile repetition: four times the page takes less than ten times as long, and the text stays below a small multiple of the page."""
    times = []
    for n in (4_000, 16_000):
        html = part * n
        began = time.process_time()
        text = html_text.visible_text(html)
        times.append(time.process_time() - began)
        assert len(text) < 40 * len(html) + 40_000
    assert times[1] < 10 * times[0] + 0.5, times


def test_wide_tables_stay_small():
    for html in (
        "<table><tr><td>" + "w" * 50_000 + "<td>x" + "<tr><td>a<td>b" * 5_000 + "</table>",
        "<table>" + "<tr><td colspan=1000 rowspan=1000>x<td>y" * 2_000 + "</table>",
        "<table><tr>" + "<td>a" * 4_000 + "<td>" + "z<br>" * 4_000 + "</table>",
        "<table><tr><td>" * 50 + "w" * 2_000 + "<tr><td>a<td>b</table>" * 50,
    ):
        began = time.process_time()
        text = html_text.visible_text(html)
        assert len(text) < 20 * len(html) + 40_000 and time.process_time() - began < 5
    text = html_text.visible_text("<table><tr><td>" + "w" * 50_000 + "<td>x" + "<tr><td>a<td>b" * 5_000 + "</table>")
    assert text.split()[:4] == ["w" * 50_000, "x", "a", "b"] and text.count("b") == 5_000


def plain_words(html):
    """Words of a well-formed page in order, by leaving out hidden elements and tags: no tree, no layout."""
    for tag in ("script", "style", "title", "noscript", "template"):
        html = re.sub(rf"(?is)<{tag}\b.*?</{tag}\s*>", " ", html)
    html = re.sub(r"(?s)<!--.*?-->", "", html)
    html = re.sub(r"(?i)</?(b|i|a|em|strong|span|u|code|small|font|wbr)\b[^>]*>", "", html)
    return unescape(re.sub(r"<[^>]*>", " ", html)).split()


def test_query_against_plain_words(spark):
    """Where no attribute hides or adds text, a page's words, without marks of lists, are those of the plain reading, in order but for tables."""
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    checked = 0
    for r in queries.op3_html_extraction(spark, SF_DIR).collect():
        html = pages[r["page_id"]]
        if re.search(r"(?i)hidden|display\s*:\s*none|\balt=|<input|<details", html):
            continue
        words = [w for w in r["text"].split() if not re.fullmatch(r"[->]|\d+\.", w)]
        want = [w for w in plain_words(html) if not re.fullmatch(r"[->]|\d+\.", w)]
        assert Counter(words) == Counter(want), r["page_id"]
        if "<table" not in html.lower():
            assert words == want, r["page_id"]
        checked += 1
    assert checked > 0.3 * len(pages), (checked, len(pages))
