"""Main text of pages: an independent reading of the test pages, and hand-made pages."""

import html
import re

import pyarrow.parquet as pq
import pytest

from conftest import collected
from encore.llm.extraction import main_text, main_texts
from encore.llm.queries import QUERIES


def article(page):
    """The text of the one article of a test page, by cutting its tags away."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    inside = re.sub("</?b>", "", re.sub("<br>", " ", re.sub("</?(p|h1)>", "\0", inside)))
    assert "<" not in inside
    return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in inside.split("\0")) if x)


def test_all_pages(spark, small):
    t = pq.read_table(f"{small}/pages.parquet").to_pydict()
    want = [(i, u, article(h), len(article(h))) for i, u, h in zip(t["page_id"], t["url"], t["html"])]
    assert collected(QUERIES["op8_tree_scoring"](spark, small)) == sorted(want)


PAGE = """<html><head><title>T</title></head><body class="nav-open"><header><h1>Site</h1></header>
<div id="cookie-banner">We use cookies, many, many, many cookies</div><div class="wrap has-sidebar">
<nav><a href=x>Home</a></nav>{0}<div class="sidebar"><p>Other, more, of, the same</p></div></div>
<form><p>Write, to, us, now</p></form><section id="comments"><article class="comment"><p>Nice, very, nice, indeed,
I say, and say again, and again</p></article></section><footer>Impressum</footer><script>a < b, c</script></body>"""


@pytest.mark.parametrize("inner, want", [
    ("<article><h1>Head</h1><p>One, two.<p>Three<br>four &amp; five&nbsp;six</article>", "Head\nOne, two.\nThree four & five six"),
    ("<div class=content><p>One, two, three.</p><p>Short</p><ul><li>x<li>y</ul></div>", "One, two, three.\nShort\nx\ny"),
    ("<main><p>That it.</main>", "That it."),
    ("<article><header><h1>Head</h1></header><div class=share-buttons>Share</div><p>Text</p><aside>Not</aside></article>", "Head\nText"),
    ("<article><p>Kept <b>bold, <i>both</b> rest</i> end.</p><p hidden>no</p></article>", "Kept bold, both rest end."),
])
def test_main_part_of_a_page(inner, want):
    assert main_text(PAGE.format(inner)) == want


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain, text", "plain, text"), ("<p>a<p>b", "a\nb"), ("a &lt;b&gt; &#233; &bogus;", "a <b> é &bogus;"),
    ("<div>" * 5000 + "deep", "deep"), ("<script>x</script>", ""), ("<table><tr><td>a<td>b</table>", "a\nb"),
    ("<p>" + "word " * 50_000, ("word " * 50_000).strip()),
])
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>t", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert collected(main_texts(table)) == [(None, None, "t", 1), (1, "u", "", 0), (1, "u", "", 0)]
    assert main_texts(table.limit(0)).collect() == []
