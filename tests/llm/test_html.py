import re
import time
from html import unescape

import pytest

from featspark.llm.html import extract_main_text, main_text

CASES = [
    ("<html><body><nav><a href=a>Menu, one</a></nav><article><h1>T</h1><p>One,\n two &amp; <b>three</b>four.</p></article><footer>x</footer></body></html>", "T One, two & threefour."),
    ("<body><div id=cookie-notice>Cookies, yes, ok</div><div class=post><h2>H</h2><p>Body, text, here.</p><p>Short.</p><ul><li>a</li><li>b</li></ul></div>"
     "<div class='side-bar sidebar'><p>Side, side, side, side</p></div><section class=comments><article class=comment><p>Nice, nice, nice, nice, nice</p></article></section></body>",
     "H Body, text, here. Short. a b"),
    ("<main><section><p>First part, with commas, here.</p></section><section><p>Second part, too.</p></section><aside>no</aside></main>", "First part, with commas, here. Second part, too."),
    ("<p>One<p>Two<br>three<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><form><p>Form</p></form>", "One Two three"),
    ("<article><p>a &lt;b&gt; &#233;&nbsp;&eacute; &copy; x</p><noscript>no</noscript><div hidden>no</div><div style='display: none'>no</div></article>", "a <b> é é © x"),
    ("<article><p title='a > b'>in</p><unknown>kept</unknown></article>", "in kept"),
    ("<body><div class='layout has-sidebar no-comments'><div class=post><p>In, the, page.</p></div><div class='sidebar'><p>Side, side</p></div></div></body>", "In, the, page."),
    ("<body><div id=top><a href=/x/>Home</a> <a href=/y/>News</a></div><section><p>Long first, with commas, and more, and more.</p></section><section><p>Short.</p></section></body>",
     "Long first, with commas, and more, and more. Short."),
    ("<body><table><tr><td>Menu</td><td><p>Some, long, text, in, a, cell.</p><p>And more.</p></td></tr></table></body>", "Menu Some, long, text, in, a, cell. And more."),
    ("<div><div><p>Deep, deep, text, with, commas.</p></div><div><p>Its second part</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>", "Deep, deep, text, with, commas. Its second part"),
    ("<div class=story><p>A, b, c.<!-- never > ended <p>x</p>", "A, b, c."),
    ("<p>Empty <a name='x'/>anchor, here</p>", "Empty anchor, here"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("just text", "just text"), ("<", "<"), ("<p", "<p"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_cases(html, text):
    assert main_text(html) == text


def test_every_page_holds_its_whole_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        text = " ".join(unescape(re.sub(r"</?(?:p|h1|br)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (1, None, None, "x", "y"), (None, "u", "<p>" + "long, " * 50_000, None, None), (2, "u", "<div>" * 3000 + "deep", None, None)]
    got = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, 0), (1, 0), (None, 299_999), (2, 4)]
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("html", ["<a " * 300_000, "<div>" * 20_000 + "<p>x, y</p>" * 20_000, "<span>" * 20_000 + "<div>a</div>" * 20_000, "<div>" * 20_000 + "</b>" * 20_000,
                                  "<a \"" * 200_000, "<!-- " * 200_000, "<li>" * 50_000, "<span>" * 20_000 + "<li>a" * 20_000, "<b><i>" * 20_000 + "</b>" * 20_000])
def test_linear_time(html):
    began = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - began < 5
