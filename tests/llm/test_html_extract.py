import pytest

from shelfrate.llm.dom import read
from shelfrate.llm.html_extract import extract_main_text, main_text, style_tree
from shelfrate.llm.url_filter import url_host
from pyspark.sql import functions as F

ARTICLE = "<h1>Head &amp; line</h1><p>One\n  two&nbsp;<b>th</b>ree<br>four</p><p>Five &lt;six&gt; &#233;</p>"
WANT = "Head & line One two three four Five <six> é"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain text &amp; more", "plain text & more"),
    (f"<html><body><nav><a href='/'>Menu</a></nav><article>{ARTICLE}</article><footer>(c)</footer></body></html>", WANT),
    (f"<body><article>{ARTICLE}<div class='comments'><p>nice</p></div></article><aside>side</aside>", WANT),
    (f"<article>{ARTICLE}<script>var a='</p>';if(a<b){{}}</script><style>p{{}}</style><!-- no <p>x</p> --></article>", WANT),
    (f"<header>Site</header><article><header><h1>Head &amp; line</h1><p>by me</p></header>{ARTICLE[24:]}</article>", WANT),
    ("<article><p>a<p>b<b>c<p>d", "a bc d"), ("<article><p>x</p><!-- open comment <p>y</p>", "x"),
    ("<article><p>x</p><script>never closed <p>y</p>", "x"), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ('<article><p title="a > b">x</p></article>', "x"), ("<div><p>x</div></p></span>y", "x y"),
    ("<div class='content'><p>x</p></div><div class='cookie-notice'>ok</div><form>name <input></form>", "x"),
    ("<body class='has-sidebar'><p>x</p></body>", "x"), ("<article class='comment'>c</article><main><p>x</p></main>", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"), ("<" * 5000, "<" * 5000),
    ("<p>" + "word " * 20000 + "</p>", ("word " * 20000).strip()),
])
def test_main_text(page, want):
    assert main_text(page, frozenset()) == want


def test_paths():
    blocks, styles = read("<body><div id='a1' class='X y'><p>t</p><p>u</p></div></body>")
    assert [b.path for b in blocks] == ["/body/div.a.x.y/p"] * 2
    assert ("/body/div.a.x.y", "p") in styles


SCHEMA = "page_id long, url string, html string, text string"


def site(host, n, start):
    return [(start + i, f"http://{host}/{i}", f"<body><div class='top'>Welcome to our shop</div><div class='body'><p>Story {i} "
             f"about topic {i * 7}</p></div><div class='end'>All rights reserved</div></body>", "clash") for i in range(n)]


def test_site_template_leaves_and_content_stays(spark):
    rows = site("many.org", 12, 0) + site("few.org", 2, 100) + [
        (200, None, "<p>x</p>", "c"), (201, "nourl", None, "c"), (None, "http://many.org/n", site("many.org", 1, 0)[0][2], "c")]
    pages = spark.createDataFrame(rows + [rows[0]], SCHEMA)
    got = extract_main_text(pages).collect()
    assert len(got) == len(rows) + 1
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == "Story 3 about topic 21" and texts[None] == "Story 0 about topic 0"
    assert texts[100] == "Welcome to our shop Story 0 about topic 0 All rights reserved"
    assert texts[200] == "x" and texts[201] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_tree_decides_inside_articles(spark):
    """A shared line in an article leaves; a text in a div beside teaser articles stays."""
    rows = [(i, f"http://a.org/{i}", f"<body><article><p>Story {i} about topic {i * 7}</p><div class='end'>All rights reserved"
             "</div></article></body>", "") for i in range(12)]
    rows += [(100 + i, f"http://b.org/{i}", f"<body><div class='body'><p>Story {i} about topic {i * 7} of many lines</p></div>"
              f"<article class='card'><h2>Read</h2></article><article class='card'><p>No {i}</p></article></body>", "")
             for i in range(12)]
    texts = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(texts[i] == f"Story {i} about topic {i * 7}" for i in range(12))
    assert all(texts[100 + i].startswith(f"Story {i} about topic {i * 7} of many lines") and "Read" not in texts[100 + i]
               for i in range(12))


def test_copies_of_a_page_are_one_page(spark):
    """Many copies of one page must not make its text look like a template."""
    rows = [(i, "http://h.org/a", "<body><div><p>The same story</p></div></body>", "") for i in range(30)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert {r.text for r in extract_main_text(pages).collect()} == {"The same story"}
    tree = style_tree(pages.select(url_host(F.col("url")).alias("host"), "html")).collect()
    assert {r.n_pages for r in tree} == {1} and {r.importance for r in tree} == {1.0}
