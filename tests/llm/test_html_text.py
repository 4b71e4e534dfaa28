import html
import re
import time

import pytest

from markbook.llm import html_text

GOOD = "The story of the old town and its harbour is told in this part, and it goes on for a while to be long enough."


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Title</h1><p>Be.</p><p>A &amp; b&nbsp;c</p></article><p>out</p>", "Title\nBe.\nA & b c"),
        ("<nav><ul><li><a href=x>Menu</a></ul></nav><main><p>One\n two</p></main>", "One two"),
        ("<article><p>Text</p><div class='comments'><p>First!</p></div><aside>Side</aside></article>", "Text"),
        ("<article><p>Text<div id=\"cookie-notice\">Accept</div><form>Name</form></p></article>", "Text"),
        ("<div class='site-header'>Site</div><article class=post><div class='entry-header'><h1>Own title</h1></div><p>a<br>b<br><br>c</p></article>", "Own title\na b\nc"),
        ("<article><p>x<!-- no --><b>y</b>z<style>p{}</style></article>", "xyz"),
        ("<article><p>&lt;p&gt; stays</p><span class='ad'>buy</span></article>", "<p> stays"),
        (f"<h2>Head</h2><p>{GOOD}{GOOD}</p><p>Short.</p><p>{GOOD}{GOOD}</p>", f"Head\n{GOOD}{GOOD}\nShort.\n{GOOD}{GOOD}"),
        (f"<p>{GOOD}{GOOD}</p><p><a href=x>all of it is a link</a></p>", f"{GOOD}{GOOD}"),
        ("<div class=footer>f</div>", ""),
    ],
)
def test_blocks(body, text):
    assert html_text.main_text(page(body)) == text


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<main class='content has-sidebar'><article><p>Text.</p></article></main>", "Text."),
        ("<article class='post share-enabled'><p>Text.</p></article>", "Text."),
        (f"<div class='page with-sidebar'><p>{GOOD}{GOOD}</p></div>", f"{GOOD}{GOOD}"),
        (f"<div class='sidebar-layout'><p>{GOOD}{GOOD}</p><p>{GOOD}</p></div><div class='sidebar'><p>{GOOD}</p></div>", f"{GOOD}{GOOD}\n{GOOD}"),
        (f"<form id=aspnetForm><nav>Menu</nav><h1>Title</h1><p>{GOOD}{GOOD}</p><form><p>Mail</p></form></form>", f"Title\n{GOOD}{GOOD}"),
        ("<form><main class=widget><p>Short.</p></main></form><p>out</p>", "Short."),
        (f"<p>{GOOD}{GOOD}</p><select><option>One<p>{GOOD}{GOOD}</p>", f"{GOOD}{GOOD}"),
        (f"<p>{GOOD}{GOOD}</p><select><div>Text behind.</div><p>{GOOD}{GOOD}</p>", f"{GOOD}{GOOD}\nText behind.\n{GOOD}{GOOD}"),
        (f"<p>{GOOD}{GOOD}</p><div class=comments><p>{GOOD}{GOOD}</p><p>{GOOD}{GOOD}</p></div>", f"{GOOD}{GOOD}"),
        (f"<p>{GOOD}{GOOD}</p><div hidden><p>{GOOD}{GOOD}</p><p>{GOOD}{GOOD}</p></div>", f"{GOOD}{GOOD}"),
        (f"<div class=newsletter><form><p>{GOOD}</p></form></div><article><p>Text.</p></article><p>{GOOD}{GOOD}</p>", f"Text.\n{GOOD}{GOOD}"),
    ],
)
def test_names_around_most_of_the_text_do_not_count(body, text):
    assert html_text.main_text(page(body)) == text


@pytest.mark.parametrize("unit", ["<div>", "<div></span>", "<div class=sidebar>", "<select>", "<svg><p>x", "<form><b class=ad>", "<main class=nav>"])
def test_unclosed_elements_take_linear_time(unit):
    start = time.time()
    html_text.main_text(unit * 100_000 + "x" + "</span>" * 100_000)
    assert time.time() - start < 5


def test_short_blocks_inherit_from_the_nearest():
    links = "<p><a href=x>one link</a></p>"
    body = f"<p>{GOOD}{GOOD}</p><p>near good</p>{links}<p>near bad</p>{links}<div>between</div><p>{GOOD}{GOOD}</p>"
    assert html_text.main_text(page(body)) == f"{GOOD}{GOOD}\nnear good\n{GOOD}{GOOD}"
    body = f"{links}<p>{GOOD}{GOOD}</p><p>Yes.</p><p>No.</p><p>Maybe.</p>{links}"
    assert html_text.main_text(page(body)).startswith(f"{GOOD}{GOOD}\nYes.")


@pytest.mark.parametrize(
    "broken",
    [None, "", "<", "<p", "<!--", "<script>", "<a href='x", "</p></p>", "&", "&#xZ;", "<p>" * 50_000, "<" * 50_000,
     "<div class=\"x" * 20_000, "a" * 1_000_000, "<a '\"" * 20_000],
)
def test_broken_pages_are_quick_and_whole(broken):
    start = time.time()
    assert isinstance(html_text.main_text(broken), str)
    assert time.time() - start < 10


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(texts)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", texts[r["page_id"]], re.S)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_odd_rows(spark):
    rows = [(1, "u", "<p>x", "t", 5), (1, "u", "<p>x", "t", 5), (None, None, None, None, None), (2, None, "", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=repr)
    assert got == [(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0), (None, None, "", 0)]
    assert html_text.extract(pages.where("page_id > 5")).count() == 0


def test_text_outside_a_teaser_article_is_weighed():
    got = html_text.main_text(page(f"<article><p>Teaser.</p></article><p>{GOOD}{GOOD}</p><p>out</p>"))
    assert got == f"Teaser.\n{GOOD}{GOOD}"


def test_given_pages_without_their_article_element(spark):
    equal = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner))
        want = [x for x in (" ".join(html.unescape(p).split()) for p in parts) if x]
        got = html_text.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", r["html"]))
        assert set(got.split("\n")) <= {*want, ""}
        equal += got == "\n".join(want)
    assert equal >= 200  # 120 of 250 when only the article element was read
