"""Main text of pages with telling body marks, deep nesting, and broken or very long markup."""

import json
import random
import time

import pytest

from sentrel.llm import html as h

ARTICLE = "<article><h2>T</h2><p>Text one.</p><p>Text two.</p></article>"


def text_of(page):
    return "\n".join(h.extract(h.parse(page), h.main_places(h.fold(h.parse(page)))))


@pytest.mark.parametrize(
    "around",
    [
        '<body class="post has-sidebar">{}<div class="sidebar">no</div></body>',
        '<body class="page no-sidebar with-comments"><main class="main with-sidebar">{}</main></body>',
        '<body id="search" class="home menu"><main class="header">{}</main><div class="cookie-notice">no</div></body>',
        '<body><div class="content-with-sidebar">{}</div><div class="site-header">no</div></body>',
        '<html class="no-js"><body>{}<div class="sticky-header-wrap">no</div><div class="legal">no</div></body>',
    ],
)
def test_marks_of_a_whole_page_hide_nothing(spark, around):
    assert text_of(around.format(ARTICLE)) == "T\nText one.\nText two."
    rows = [(i, f"http://a.org/{i}", around.format(ARTICLE.replace("one", str(i)))) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.main_text(df).collect()} == {i: f"T\nText {i}.\nText two." for i in range(3)}


def test_marks_inside_an_article():
    inside = (
        '<div class="entry-header"><h1>Head</h1></div><div class="legal-opinion"><p>Opinion.</p></div><p>x</p>'
        '<div class="post-comments">no</div><div class="legal notice">no</div><div class="share-links">no</div>'
    )
    assert text_of(f"<body><article>{inside}</article></body>") == "Head\nOpinion.\nx"


def test_twenty_thousand_levels(spark):
    deep = "<body><p>before</p>" + "<div>" * 20_000 + "text" + "</div>" * 20_000 + "<p>after</p></body>"
    unclosed = "<body><article>" + "<div><p>a" * 20_000
    df = spark.createDataFrame([(1, "http://a/", deep), (2, "http://b/", unclosed)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert got == {1: "before\ntext\nafter", 2: "\n".join(["a"] * 20_000)}


@pytest.mark.parametrize("page", ["<a x " * 200_000 + '"', "<a '" * 200_000 + '"', '<a x="' * 150_000, "<" * 1_000_000, '<p a="\'' * 150_000])
def test_broken_markup_takes_linear_time(page):
    start = time.process_time()
    text_of(page)
    assert time.process_time() - start < 20


def test_a_tag_without_end_stops_at_the_next():
    assert text_of("<body><p>one<b <p>two</p><p class='x'>three</body>") == "one\ntwo\nthree"


def test_wrappers_stay_small_and_aligning_fast():
    start = time.process_time()
    a = h.fold(h.parse("<h2>a</h2><p>b</p>" * 20_000))
    b = h.fold(h.parse("<h2>a</h2><ul><li>x</li></ul><p>b</p>" * 20_000))
    assert h.expression(h.align(a, b)) == '(<h2>"a"</h2>)+(<ul><li>"x"</li></ul>)*(<p>"b"</p>)+'
    assert time.process_time() - start < 30
    rnd, wrapper = random.Random(1), None
    parts = ["<h2>a</h2>", "<p>b</p>", "<ul><li>c</li></ul>", "<pre>x</pre>", "<table><tr><td>x</td></tr></table>"]
    for _ in range(300):
        page = h.fold(h.parse("<article>" + "".join(rnd.choices(parts, k=40)) + "</article>"))
        wrapper = h.align(wrapper, page) if wrapper else page
    assert len(json.dumps(h.pack(wrapper))) < 20_000
