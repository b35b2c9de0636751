"""The parser's tree and selectors: children, unknown selectors, and elements without end tags."""

from __future__ import annotations

import pytest

from jobloom.sources import html


def _texts(page, selector):
    return [n.text() for n in html.select(html.parsed(page), selector)]


def test_selectors():
    page = '<div id=a class="x y"><ul><li>1<li>2<ol><li>3</ol></ul><p data-k="a > b, c">4<span>5</span></div><ul><li class=y>6</ul>'
    assert _texts(page, "ul > li") == ["1", "23", "6"] and _texts(page, "ul>li") == ["1", "23", "6"] and _texts(page, "ul li") == ["1", "23", "3", "6"]
    assert _texts(page, "div > li") == [] and _texts(page, "div#a.x.y > p > span, .y > ul") == ["123", "5"] and _texts(page, "li > ol > li") == ["3"]
    assert _texts(page, '[data-k="a > b, c"]') == ["45"] and _texts(page, "*.y") == ["12345", "6"] and _texts(page, "p *") == ["5"] and _texts(page, "[data-k*='b'][data-k$=c]") == ["45"]
    # two ways up: the nearest ancestor does not fit what is above it, a farther one does
    assert _texts("<i><b><u><b><s>1</s></b></u></b></i>", "i > b s") == ["1"]


@pytest.mark.parametrize("selector", ["ul + li", "ul ~ li", "li:first-child", "> li", "ul >", "ul > > li", "", "a,,b", "li::before", "a[b", "a!b"])
def test_selectors_that_are_not_known_are_refused(selector):
    with pytest.raises(ValueError, match="selector"):
        html.select(html.parsed("<li>1"), selector)


def test_elements_without_end_tags():
    assert _texts("<ul><li>a<li>b<p>c<p>d<div>e</div><li>f</ul>g", "li") == ["a", "bcde", "f"]
    assert _texts("<p>a<p>b<b>c<p>d</b><div>e<p>f</div>g", "p") == ["a", "bc", "d", "f"]
    assert _texts("<table><tr><td>a<td>b<tr><th>c<td>d<table><tr><td>e</table></table>", "td") == ["a", "b", "de", "e"]
    assert _texts("<dl><dt>a<dd>b<dt>c</dl><select><option>x<option>y</select>", "dt, dd, option") == ["a", "b", "c", "x", "y"]
    assert _texts("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "li") == ["abc", "b", "c", "d"] and _texts("<li><a>x</a></li><li><a>y", "li > a") == ["x", "y"]
