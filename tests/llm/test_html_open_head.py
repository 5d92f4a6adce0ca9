"""Pages whose head is left open, and text that browsers show outside of plain blocks."""

import pytest

from thicket.llm.html_render import NESTED, build, render, title


@pytest.mark.parametrize("page,text", [
    ("<head><title>T</title><p>Hello", "Hello"),
    ("<html><head><meta charset=x><title>T</title>\nplain <b>text</b>", "plain text"),
    ("<head><title>T</title><style>p{}</style><script>1</script></head><body>x", "x"),
    ("<head><template><p>no</p></template><noscript><p>no</p></noscript><p>yes", "yes"),
    ("<p aria-hidden=true>seen</p>", "seen"),
    ("<svg><title>no</title><text>one</text><text>two</text></svg>", "one\ntwo"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"),
    ("<table><tr><td>" * (NESTED + 1) + "a<td>b", "a b"),
])
def test_visible_text_stays(page, text):
    assert render(build(page)) == text


def test_title_of_an_open_head():
    assert title(build("<head><title>T</title><p>Hello")) == "T"
