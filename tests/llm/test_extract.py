"""Operator 12: pages of many layouts, whose main text is known; the scan against all stretches."""

import html
import random
import re

import pytest
from plumbline.llm import extract, markup
from pyspark.sql import functions as F

WANT = "Title of it\n\nFirst words & more here, of some length.\n\nSecond one with a link in it.\n\nEnd."
BODY = "<h1>Title  of\n it</h1><p>First words &amp; more&nbsp;here, of some length.<p>Second one with a <a href='/x'>link</a> in it.</p><p>End.</p>"
NOISE = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News of the day and of the week</a></ul></nav><header><h1>The Site</h1><p>Words of the site</p></header>"
TAIL = "<footer>&copy; The site, with many more words than the article has, so that they would count if they were words of it</footer></body></html>"
LONG = "many words that are no part of it but make a long paragraph " * 9

PAGES = {
    "article": f"<html><body>{NOISE}<article>{BODY}</article>{TAIL}",
    "main": f"<body>{NOISE}<main>{BODY}</main>{TAIL}",
    "main and article": f"<body><div class=banner>{LONG}</div><main><article>{BODY}</article></main>{TAIL}",
    "role": f"<body>{NOISE}<div role='main'>{BODY}</div><div role=complementary><p>{LONG}</p></div>{TAIL}",
    "no article": f"<body>{NOISE}<div id=content>{BODY}</div>{TAIL}",
    "sidebar": f"<body><div class='page has-sidebar'><div class=sidebar><p>{LONG}</div><div>{BODY}</div></div>",
    "aside inside": f"<article>{BODY.replace('<p>End.', f'<aside><p>{LONG}</aside><p>End.')}</article>",
    "advert inside": f"<article>{BODY.replace('<p>End.', f'<div class="ad-slot"><p>{LONG}</div><p>End.')}</article>",
    "comments": f"<body><article>{BODY}<section id=comments><p>{LONG}</p></section></article><div class=CommentList><article><p>{LONG}{LONG}</article></div>",
    "comments as articles": f"<article>{BODY}<article><p>{LONG}</p></article></article>",
    "notice": f"<body><div class='cookie-notice'><p>{LONG}</p></div><article>{BODY}</article>",
    "form": f"<article>{BODY}<form action=/><p>Write to us<textarea>{LONG}</textarea><button>Send</button></form></article>",
    "page in a form": f"<body><form id=f>{NOISE}<article>{BODY}</article></form>",
    "script": f"<head><title>T</title><style>p{{x:'</p>'}}</style></head><article><script>if (a<b) x='</article><p>no';</script>{BODY}<noscript>{LONG}</noscript></article>",
    "comment marks": f"<article><!-- <p>{LONG}</p> -->{BODY}<!-- open <p>{LONG}",
    "hidden": f"<article>{BODY}<p hidden>{LONG}<p style='display: none'>{LONG}</p></article>",
    "header inside": f"<article><header><h1>Title of it</h1><p>By a writer</p></header>{BODY.split('</h1>')[1]}</article>",
    "quotes": f"""<article data-x='a > b' title="c > d">{BODY}</article>""",
    "teasers": f"<body><article>{BODY}</article><div class=related><article><h2>{LONG}</h2></article></div>",
    "upper case": f"<BODY>{NOISE}<ARTICLE>{BODY.replace('<p>', '<P>')}</ARTICLE>{TAIL}",
    "open inline": f"<article>{BODY.replace('<p>', '<p><b><i>')}</article>{TAIL}",
    "ends after it": f"<body>{NOISE}<article>{BODY}",
}
NONE = ["", None, "<", "<p", "<!--", "<html></html>", "<nav>a b c</nav>", "<article></article><p>x</p>", "</p></p>", "<script>", "&", "<article><nav>a</nav></article>", '<p class="']


@pytest.fixture(scope="module")
def weights(spark):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate([*PAGES.values(), *NONE])], "page_id int, html string")
    return extract.fit(pages)


@pytest.mark.parametrize("name", list(PAGES))
def test_layouts(weights, name):
    assert extract.main_text(PAGES[name], weights) == WANT


@pytest.mark.parametrize("name", ["article", "no article", "comments", "sidebar"])
def test_layouts_without_a_sample(spark, name):
    alone = extract.fit(spark.createDataFrame([], "page_id int, html string"))
    assert extract.main_text(PAGES[name], alone) == WANT


def test_without_text(weights):
    assert [extract.main_text(h, weights) for h in NONE] == [h if h in ("&", "<") else "" for h in NONE]


def test_labelled_pages_give_their_label(weights):
    firsts = ["A bridge opens", "Notes on bread", "How to mend a tyre", "Rain"]
    lasts = ["More works follow.", "Water 350 g", "Ride", "water that falls"]
    got = [extract.main_text(h, weights).split("\n\n") for h in extract.LABELLED]
    assert [g[0] for g in got] == firsts and [g[-1] for g in got] == lasts


def test_table(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate([*PAGES.values(), *NONE, PAGES["main"]])]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = extract.extract(df.withColumns({"text": F.lit("own"), "key": F.lit("own"), "_h": F.lit("own")})).collect()
    assert len(got) == len(rows) and {r.key + r["_h"] for r in got} == {"ownown"}
    texts = {r.page_id: r.text for r in got}
    assert [texts[i] for i in range(len(PAGES))] == [WANT] * len(PAGES) and all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(df.limit(0)).columns == ["page_id", "url", "html", "text", "n_chars"]


def test_given_pages(spark):
    """The pages of the tables against their own articles, read by a plain expression."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = extract.extract(df).collect()
    for r in got:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_scan_against_all_stretches():
    r = random.Random(3)
    for _ in range(300):
        scores = [(i, r.choice([-3, -1, -0.5, 0.5, 1, 2]), r.choice([0, 0, 1])) for i in range(r.randint(0, 12))]
        sums = [(sum(s for _, s, _ in scores[a : b + 1]), a, b) for a in range(len(scores)) for b in range(a, len(scores)) if len({w for _, _, w in scores[a : b + 1]}) == 1]
        top = max((s for s, _, _ in sums), default=0)
        found = extract.best(iter(scores))
        if top <= 0:
            assert found is None
        else:
            assert (top, *found) in sums


def test_long_and_deep_pages_take_linear_time(weights):
    import time

    for h in ("<div>" * 40_000 + BODY, "<p><b>" * 40_000, "<li><ul>" * 20_000, "</i>" * 80_000, '<p a="' * 40_000, "<!-" * 60_000, "<article>" * 30_000 + BODY, "<ul>" + "<b>" * 30_000 + "<li>x" * 30_000, "a < b " * 60_000):
        start = time.time()
        extract.main_text(h, weights)
        assert time.time() - start < 20
    assert extract.main_text("<article>" + "<p>some words of it</p>" * 60_000 + "</article>", weights).count("\n\n") == 59_999


def test_tree():
    page = markup.Page("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><td>g</table><p>h<div>i</div>")
    inside = {t: page.names[e] for k, e, t in page.events if k == markup.TEXT}
    assert inside == {"a": "li", "b": "li", "c": "li", "d": "li", "e": "td", "f": "td", "g": "td", "h": "p", "i": "div"}
    assert sum(k == markup.OPEN for k, _, _ in page.events) == sum(k == markup.CLOSE for k, _, _ in page.events)
