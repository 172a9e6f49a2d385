import time

import pytest

from tessella.operators.optimize import optimize_fragment, optimized
from tessella.sources.markup import parse
from tessella.sources.stylesheet import parse as sheet


def outline(text):
    return " ".join(n.text.strip() or n.tag or n.kind for n in parse(text).walk() if n.kind != "fragment" and n.tag not in ("html", "head"))


@pytest.mark.parametrize("text,want", [
    ('<a title="x>y">hi</a>', "body a hi"), ("a < b <c", "body a < b <c"), ("<!-->x", "comment body x"), ("<!-- c", "c body"),
    ("<p>x<p>y", "body p x p y"), ("<ul><li>a<li>b</ul>c", "body ul li a li b c"), ("<table><tr><td>a</div>b<td>c</table>", "body table tr td a b td c"),
    ("<p><b>x</p><p>y</b>z</p>", "body p b x p b y z"), ("<p><b><i>x</p>y", "body p b i x b i y"), ("<table><td><b>x</td><td>y</table>", "body table td b x td y"),
    ("<b>x</i>y</b>", "body b x y"), ("<a>x<a>y", "body a x a y"), ("<script>a</p></script>b", "script body b"), ("<title>t</title>z", "title t body z"),
])
def test_trees(text, want):
    assert outline(text) == want


N = 30_000
HOSTILE = {
    "names": "<a" * 10 * N, "quotes": "<a b='" * N + ">", "quoted ends": '<a b=">" ' * N, "stray ends": "<div>" * N + "</x>" * N, "comments": "<!--" * 10 * N, "cdata": "<![CDATA[" * N + ">",
    "items": "<ul>" + "<b>" * N + "<li></li>" * N, "formatting": "".join(f"<b a={i}>" for i in range(N)) + "<p>x</p>" * N, "titles": "<title>" * N, "wrappers": "<div><p>x</p></div>" * N, "deep": "<div>" * N + "<p>x</p>" + "</div>" * N,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_in_proportion_to_the_length(name):
    text, began = HOSTILE[name], time.process_time()
    new, *_ = optimized(text, sheet(""))
    short = optimize_fragment(text)
    assert time.process_time() - began < 20  # a few seconds; what grows with the square takes minutes
    if name == "wrappers":
        assert new == short == "<p>x</p>" * N
    if name == "deep":
        assert new == short == "<p>x</p>"
