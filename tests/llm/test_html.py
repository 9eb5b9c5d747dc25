"""The scan decides: brute force over all regions, unmarked and wrongly marked pages, long and broken ones."""

import random
import time

import pytest

from tests.llm.helpers import prose
from tests.llm.test_filters import ARTICLE, MAIN, NOISE
from veilframe.llm import html

FITTED = html.fit_weights(*html.kind_counts("<html><body>" + "".join(NOISE) + ARTICLE * 3 + "</body></html>"))
WEIGHTS = pytest.mark.parametrize("weights", [{}, FITTED], ids=["plain", "fitted"])


@pytest.mark.parametrize("seed", range(60))
def test_scan_equals_all_regions(seed):
    r = random.Random(seed)
    x = [r.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(r.randrange(40))]
    lo, hi = html.best_region(x)
    assert sum(x[lo:hi]) == max([0.0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])


@WEIGHTS
def test_region_of_a_page_equals_all_regions(weights):
    weights = weights or html.fit_weights({}, {})
    for k in range(20):
        r = random.Random(k)
        page = "".join(r.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<article>", "</article>", "<div class=related>", prose(k, 3) + " ", prose(k + 1, 9)]) for _ in range(60))
        x = html.scores([t for t in html.tokens(page) if not t.cut], weights)
        lo, hi = html.best_region(x)
        assert sum(x[lo:hi]) == pytest.approx(max([0.0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]))


@WEIGHTS
def test_the_scan_changes_what_comes_out(weights, monkeypatch):
    """Unmarked and wrongly marked pages: without the scan links and teasers would stay."""
    body = f"<h2>Head</h2><p>{prose(3, 60)}<p>{prose(4, 60)}"
    links = "<div>" + "<a href=1>one</a> <a href=2>two</a> " * 6 + "</div>"
    pages = [f"<body>{links}<div>{body}</div>{links}", f"<main><h1>T</h1></main>{links}<div>{body}</div>", f"<article>Teaser here</article><article>{body}</article><article>Other teaser</article>"]
    want = f"Head\n\n{prose(3, 60)}\n\n{prose(4, 60)}"
    got = [html.main_text(p, weights) for p in pages]
    assert got[0] == want and want in got[1] and got[2] == want
    monkeypatch.setattr(html, "best_region", lambda x: (0, len(x)))
    assert all(html.main_text(p, weights) != g for p, g in zip(pages, got))


@WEIGHTS
def test_nothing_of_the_article_is_lost(weights):
    text = prose(5, 40)
    for inner, extra in [
        ("<p>where <math><mi>x</mi></math> is</p>", "where x is"),
        ("<object data=a>Words of the object</object>", "Words of the object"),
        ('<p class="legal">Some legal words</p>', "Some legal words"),
        ('<div class="social">Words of society</div>', "Words of society"),
        ('<div class="article-header"><h1>The title</h1></div>', "The title"),
        ("<ul><li>a<li>b<li>c</ul>", "a\n\nb\n\nc"),
    ]:
        got = html.main_text(f"<body><nav>x y</nav><article>{inner}<p>{text}</article><footer>z</footer>", weights)
        assert got == f"{extra}\n\n{text}", inner


@WEIGHTS
def test_a_mark_is_no_switch(weights):
    words = prose(6, 300)
    assert words in html.main_text(f"<main><h1>T</h1></main><div>{words}</div>", weights)
    assert html.main_text(f"<article>{words}</article><div>{prose(7, 40)}</div>", weights) == words
    assert html.main_text(f"<main><h1>Title of it</h1><article>{words}</article></main>", weights) == f"Title of it\n\n{words}"


@WEIGHTS
def test_class_words_are_weighed(weights):
    words = prose(8, 80)
    assert html.main_text(f'<div class="discussion">{words}</div>', weights) == words
    comments = "<li>I like this a lot, thanks</li>" * 4
    assert html.main_text(f'<article><p>{words}</p></article><ol class="thread">{comments}</ol>', weights) == words
    assert html.main_text(f'<article><p>{words}</p><ol class="thread">{comments}</ol></article>', weights) == words


def test_class_words_are_learned():
    page = '<body><div class="zebra">' + prose(1, 40) + "</div><article><p>" + prose(2, 200) + "</p></article></body>"
    weights = html.fit_weights(*html.kind_counts(page))
    assert weights["@zebra"] < 0
    unmarked = '<div class="zebra">' + prose(3, 30) + "</div><p>" + prose(4, 90) + "</p>"
    assert html.main_text(unmarked, weights) == prose(4, 90)
    assert prose(3, 30) in html.main_text(unmarked, {})


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "<div>x" * 100, "<b><div>" * 50_000, "<ul>" + "<b>" * 20_000 + "<li>x" * 20_000, "<p><i>" * 50_000, "<table>" + "<tr><td>" * 40_000, "</b>" * 100_000, "word " * 400_000, "<" * 300_000])
def test_time_is_linear(page):
    began = time.perf_counter()
    html.main_text(page, FITTED)
    assert time.perf_counter() - began < 6


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, "u", f"<body>{NOISE[0]}{ARTICLE}{NOISE[3]}", "own", 5), (None, None, None, None, None), (3, "v", "", "own", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages, html.fit(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert [(r.page_id, r.text, r.n_chars) for r in got.collect()] == [(1, MAIN, len(MAIN)), (None, "", 0), (3, "", 0)]
