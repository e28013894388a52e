import html
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from arborlake.llm import htmltext, queries

SF = "/root/testdata/sf0.001"


def text(page, template=frozenset()):
    return "\n".join(htmltext.blocks(htmltext.parse(page), template))


def slow_article(page):
    """The article of a generated page, by patterns alone."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = queries.QUERIES["op2_html_main_text"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    expected = sorted((r.page_id, r.url, slow_article(r.html), len(slow_article(r.html))) for r in pages)
    assert sorted(map(tuple, got.collect())) == expected


def test_parts_around_an_article():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar">
      <header><h1>Site</h1></header><div id="cookieNotice">We use cookies</div><nav><a href=/>Home</a></nav>
      <main><article class="post"><header><h1>Head &amp; line</h1></header><p>One<b> bold</b>&nbsp;text<br>more &#x41;&eacute;
      <p>Two <script>var x="</p>";</script>words<ul><li>a<li>b <i>c</i></ul><aside>Aside</aside><div class="share-buttons">Share</div>
      <form><input value=x>Mail?</form><table><tr><td>1<td>2</table><pre> x
        y </pre><section class="comments"><p>Nice!</p></section></article></main>
      <ul class=x><li><a>p</a><li><a>q</a><li><a>r</a></ul><div role="complementary">side</div><p hidden>no</p><footer>End</footer></body>"""
    assert text(page) == "Head & line\nOne bold text more Aé\nTwo words\na\nb c\n1\n2\nx y"
    plain = page.replace("<main><article class=\"post\"><header>", "<div>").replace("</header>", "", 1).replace("</article></main>", "</div>")
    assert "Two words" in text(plain) and "Home" not in text(plain) and "Share" not in text(plain) and "p\nq" not in text(plain)


def test_what_holds_the_article_stays():
    """Layouts whose names sound like parts around an article, and forms around the whole page."""
    article = "<article><h1>Head</h1><p>One two.</p></article>"
    for before, after in (("<div class='layout has-sidebar'>", "</div>"), ("<form action=/>", "</form>"), ("<div id=page class=no-sidebar>", "</div>"),
                          ("<div class='post-related-ad-free'><section class=promo>", "</section></div>"), ("<aside>", "</aside>")):
        assert text(f"<body><nav>Home</nav>{before}<div class=sidebar>Side</div>{article}{after}<footer>End</footer></body>") == "Head\nOne two."
    assert text("<div id='page' class='no-sidebar'><p>All the text is here.</p><div class=share>Share</div></div>") == "All the text is here."
    # Teasers beside an article in plain sight, and readers' comments, do not come back.
    assert text(f"<div class=related><article>Teaser</article></div>{article}") == "Head\nOne two."
    assert text("<p>Short.</p><div class=comments><p>A very long comment of a reader.</p></div>") == "Short."


def test_unclosed_and_stray_tags():
    assert text("<p>a<p>b</i></div>c<div>d") == "a\nbc\nd"
    assert text("no markup & none &lt;b&gt;") == "no markup & none <b>"
    assert text("<article><p><b>x<br><p>y</article>z") == "x\ny"
    assert text(None) == text("") == text("<script>x") == ""
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ap div=\"'&;!-x\n", max_size=80))
def test_any_markup_is_read(page):
    assert isinstance(text(page), str)


def page(body, host="h.org", i=0):
    return (i, f"http://{host}/{i}", f"<html><body>{body}</body></html>")


def test_recurring_subtrees_go(spark):
    box = "<div><h3>About us</h3><p>We are a shop.</p></div>"
    inner = "<div class=byline><span>Written by us</span></div>"
    rows = [page(f"{box}<div><p>Own words {i}.</p></div>", i=i) for i in range(6)]
    rows += [page(f"{box}<div><p>Other {i}.</p></div>", "few.org", i) for i in range(10, 14)]           # too few pages
    rows += [page("<div><p>Same page again.</p></div>", "copy.org", i) for i in range(20, 40)]           # copies of one page
    rows += [page(f"<article><p>Often said.</p>{inner}<p>News {i}.</p></article>", "art.org", i) for i in range(50, 60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(frame).collect()}
    assert got[0] == "Own words 0." and got[10] == "About us\nWe are a shop.\nOther 10."
    assert got[20] == "Same page again." and got[50] == "Often said.\nNews 50."


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "http://a/b", "<p>t</p>", None), (3, "", "", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, key string").withColumn("gone", F.lit(1))
    got = htmltext.main_text(frame).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "t"), (1, ""), (1, ""), (3, "")]
    assert htmltext.main_text(frame.limit(0)).count() == 0
