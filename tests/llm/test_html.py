"""Main text of pages: labelled pages come back, the test pages' articles equal an independent reading, and pages unlike both."""

import html
import re
import time

import pytest

from querent.llm.html_text import LABELLED, Page, extract, main_text, model


def test_labelled_pages_come_back():
    for page in LABELLED:
        want = " ".join(re.sub(r"<[^>]*>", " ", " ".join(re.findall("⟦(.*?)⟧", page))).split())
        got = " ".join(main_text(page.replace("⟦", "").replace("⟧", "")).split())
        assert re.sub(r" ([.,])", r"\1", got) == re.sub(r" ([.,])", r"\1", want)


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", inner)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extract(spark, pages).collect()}
    assert got == want


STORY = ["The boats came back at noon, full of fish and salt, and the market opened at once.", "Everyone bought something, even those who never eat fish.", "By two it was over."]
TEXT = "".join(f"<p>{x}</p>" for x in STORY)
ALL = "\n".join(["Fish day", *STORY])


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body class="home has-sidebar"><nav><a>Home</a><a>Sea</a></nav><h1>Fish day</h1>{TEXT}<div class="sidebar"><a>More</a></div></body></html>',
        f'<html><body class="sidebar comments footer"><h1>Fish day</h1>{TEXT}</body></html>',
        f'<html><body><div class="with-header"><article><h1>Fish day</h1>{TEXT}</article></div><footer>All rights reserved</footer></body></html>',
        f'<html><body><nav><a>Home</a></nav><article><div class="entry-header"><h1>Fish day</h1></div>{TEXT}</article></body></html>',
        f'<html><body><div class="breadcrumbs"><a>Home</a> <a>Sea</a> <a>Fish</a></div><h1>Fish day</h1>{TEXT}</body></html>',
        f'<html><body><h1>Fish day</h1>{TEXT}<div class="recirc"><h3>More stories</h3><a>Boats of the north</a><a>Salt and bread</a></div></body></html>',
        f"<h1>Fish day</h1>{TEXT}",
        f'<HTML><BODY><H1>Fish day</H1>{TEXT.upper().replace("<P>", "<P>").replace(TEXT.upper(), TEXT)}<SCRIPT>if (a<b) document.write("<p>no</p>")</SCRIPT></BODY></HTML>',
    ],
)
def test_other_pages(page):
    assert main_text(page) == ALL


def test_an_element_around_the_whole_page_decides_nothing():
    _, weights, _ = model()
    assert weights[".comments"] < 0 and main_text(f'<div class="comments discussion">{TEXT}</div>') == "\n".join(STORY)


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a \"'>", '<a ">', "<div>", "</b>", "<!--", "<script>", "&amp;", '<p class="x y">', "<a><b>", "<", "<p>word "])
def test_long_pages_take_linear_time(part):
    start = time.perf_counter()
    main_text(part * ((1 << 20) // len(part)))
    assert time.perf_counter() - start < 8  # about a second where nothing else runs; hours if it were quadratic


def test_unmatched_closing_tags_under_deep_nesting():
    start = time.perf_counter()
    assert main_text("<div>" * 50_000 + "</b>" * 50_000 + "deep words stand here.") == "deep words stand here."
    assert time.perf_counter() - start < 8


def test_tags_with_marks_inside_quotes():
    page = Page("<p title='x>y' class=\"a>b\">one</p><a href='>'>two</a> < three <3 <!-- <p>no</p> --> four")
    assert [x[1] for x in page.sequence if x[0] == "text"] == ["one", "two", " < three <3 ", " four"]


def test_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>one &amp; two&nbsp; &am</p><script>var a='</p>';", "x"), (2, "u", "plain < text", "x"), (3, "u", "<p>" * 3000 + "deep", "x"), (4, "u", "<article><p>a<b>b</b> c<p title='x>y'>d<br>e</article><nav><a>x</a></nav>", "x")]
    got = extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("2", "one & two &am"), ("2", "plain < text"), ("3", "deep"), ("4", "ab c\nd\ne"), ("None", "")]
    assert extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
