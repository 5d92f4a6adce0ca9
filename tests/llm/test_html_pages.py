"""Broken markup, spans, visibility and long pages, and the words of whole tables by another parser."""

import collections
import html.parser
import os
import re
import time

import pytest

from thicket.llm.html_render import build, extract_text, render


@pytest.mark.parametrize("page,text", [
    ("<a href=x title=it's>Hello</a> world <b>don't</b> end", "Hello world don't end"),
    ("<p title=\"open>Hello</p><p>there</p>", "Hello\n\nthere"),
    ("<a title='a>b'>x</a>", "x"),
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", "A | b1\n  | b2"),
    ("<table><tr><td>a<td rowspan=0>B<td>c<tr><td>d<td>e</table>", "a | B | c\nd |   | e"),
    ("<table><tr><td colspan=900>wide<td>x<tr><td>a</table>", "wide | x\na"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<ruby>x<rp>(</rp><rt>y</rt><rp>)</rp></ruby>", "xy"),
    ("<dialog>closed</dialog><dialog open>shown</dialog>", "shown"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
    ("<div>a</p>b", "a\nb"),
    ("<table><tr><td><p>x</table></p>y", "x\n\ny"),
])
def test_pages(page, text):
    assert re.sub(r"\n+", "\n", render(build(page))) == re.sub(r"\n+", "\n", text)


@pytest.mark.parametrize("page", [
    "<div>" * 3000 + "</x>" * 30_000, "<span>" * 20_000 + "<p>" * 5000, "<b><table><tr><td>" + "<span>" * 20_000 + "</b>" * 20_000,
    "<li>" * 20_000, "<ul><li>" * 30, "<a title='" * 30_000, "<a title=" * 30_000, "<td colspan=1000>x" * 3000,
    "<table>" + "<tr><td colspan=1000 rowspan=9>x" * 500, "<" * 100_000, "<!--" * 50_000,
])
def test_long_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    assert len(render(build(page))) < 40 * len(page)
    assert time.perf_counter() - start < 6


class Words(html.parser.HTMLParser):
    """Words of visible text by the standard library's parser, without layout."""

    SKIPPED = ("script", "style", "title", "noscript", "template", "textarea", "svg", "object", "iframe", "head")

    def __init__(self, page):
        super().__init__()
        self.skip, self.text = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "img" and not self.skip:
            self.text.append(f" {a.get('alt') or ''} ")
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            return
        if self.skip or tag in self.SKIPPED or "hidden" in a or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or ""):
            self.skip.append(tag)
        if tag not in ("b", "i", "a", "em", "strong", "span", "code"):
            self.text.append(" ")

    def handle_endtag(self, tag):
        if self.skip and tag in self.skip:
            while self.skip.pop() != tag:
                pass
        if tag not in ("b", "i", "a", "em", "strong", "span", "code"):
            self.text.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def test_words_of_the_table_by_another_parser(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("test data is not there")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    word = re.compile(r"\w+")
    equal = 0
    for r in pages.collect():
        want = collections.Counter(word.findall("".join(Words(r.html or "").text)))
        have = collections.Counter(word.findall(got[r.page_id] or ""))
        assert not want - have, (r.page_id, want - have)  # nothing visible is lost
        equal += not any(not w.isdigit() for w in have - want)  # numbers may be those of lists
    assert equal == len(got)
