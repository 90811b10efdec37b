"""Operator 12: main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score from 0 to 1 and tags below 0; one scan finds
the contiguous stretch of the largest sum, which is the article. The scores are learned from
labelled pages: of words by the block that they stand in, of tags by their names, of both by whether
the block's own words are mostly links, text or none, from how often each is inside and outside the main text. Labelled pages are those
of ``LABELLED`` and a sample of the table's own pages, which label themselves by an article or main
element; each of these counts as it is and once more as if it had no such element, so that pages
without one are scored too.

An element that is no part of an article by its name, role, class or id (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments), or is hidden, counts with all
it holds as one tag; of a header inside an article the headings stay. An article within another one
is a reader's comment, as HTML says. A stretch never runs over the edge of an article.

Within the stretch nothing else is dropped. Text is parted by block elements, character references
are decoded, white space becomes one space, and blocks are joined by an empty line.

Pages are read each on its own in Arrow batches: no shuffle but that of the sample's counts, and the
weights are a table as long as HTML's names, whatever the number of pages.

Defined cases: null or empty html, and pages without a word of main text, give an empty text; pages
of any length are read whole, in time that grows with their length alone; repeated rows each give
a row; an empty table gives none; other columns pass through; the sample is of the ``SAMPLE`` pages
with the smallest hashes (of a share of the hashes that holds four times as many pages), those of at
most ``SAMPLE_CHARS`` characters.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import packed, unpacked
from .markup import BLOCK, CLOSE, HEADING, OPEN, SPACED, Page

SAMPLE, SAMPLE_CHARS = 512, 100_000
OVERSAMPLED = 4
#: What a tag costs at least and at most, in words, and how much its log odds count.
LEAST, MOST, ODDS = 0.01, 6.0, 1.5
#: What an element that is no part of an article costs as one tag.
DROPPED = 0.02
#: Pages seen before any others, for smoothing.
PRIOR = 0.5

# Names, roles and words of classes that tell what is no part of an article.
NAMES = frozenset("head script style noscript template nav header footer aside form button select textarea input datalist iframe object embed svg canvas audio video dialog menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
WORDS = COMMENTS | frozenset(
    """ad ads adbox adsense adslot advert adverts advertisement advertisements advertising alert aside banner breadcrumb breadcrumbs colophon consent cookie cookies copyright
    footer gdpr header login masthead menu menubar modal nav navbar navigation navmenu newsletter notice notices notification outbrain overlay pager pagination paywall popular popup promo promoted promotion
    recommendations recommended related search share sharing sidebar sidenav signup skip social sponsor sponsored sponsors submenu subscribe subscription taboola toc toolbar topbar trending widget widgets""".split()
)
#: Those that count for an article element.
TEASERS = COMMENTS | frozenset("ad ads advert advertisement promo promoted recommended related sponsored teaser widget".split())
#: Words that say that the page has such a part, not that this is it; words of an article's own parts.
NEGATED = frozenset("has no with without js is not".split())
OWN = frozenset("article body content entry main page post section story text title".split())
PHRASE = frozenset("html body main em strong b i u s code kbd samp var mark abbr q cite dfn sub sup small time data ruby".split()) | HEADING

_CLASS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Labelled pages: what an element with data-main holds is the main text.
LABELLED = [
    """<body><div id="top"><a href="/">Home</a> <a href="/news">News</a> <a href="/about">About us</a></div><div class="wrap"><div class="left" data-main><h1>A bridge opens</h1><p>The new bridge over the river opened on Monday after four years of work, and the first cars crossed it at noon.</p><p>It cost <a href="/c">nine million</a> more than was planned.</p><ul><li>It is two hundred metres long</li><li>It carries four lanes and a path for bicycles</li></ul><p>More works follow.</p></div><div class="right"><h3>More</h3><ul><li><a href="/1">Town hall to be painted</a></li><li><a href="/2">School wins a prize</a></li><li><a href="/3">Market moves</a></li></ul></div></div><div id="bottom">All rights kept. <a href="/imprint">Imprint</a> <a href="/terms">Terms</a></div></body>""",
    """<body><table><tr><td><a href="/a">Index</a><br><a href="/b">Archive</a><br><a href="/c">Links</a></td><td data-main><h2>Notes on bread</h2><p>Flour, water and salt are all that is needed, and a warm place to leave the dough for a day.</p><blockquote>Bread is older than writing.</blockquote><p>Bake it hot.</p><table><tr><td>Flour</td><td>500 g</td></tr><tr><td>Water</td><td>350 g</td></tr></table></td></tr></table><p><a href="/d">Back</a> | <a href="/e">Next</a></p></body>""",
    """<body><div><span>Monday</span> <span><a href="/l">Log on</a></span></div><div><div data-main><h1>How to mend a tyre</h1><div>Take the wheel off and find the hole by holding the tube under water until bubbles rise.</div><div>Dry it, roughen it, and spread the glue thinly.</div><h2>Then wait</h2><div>Press the patch on once the glue is no longer wet.</div><ol><li>Pump</li><li>Check</li><li>Ride</li></ol></div><div><a href="/x">Tools</a></div><div><a href="/y">Wheels</a></div><div><a href="/z">Lamps</a></div></div></body>""",
    """<body><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><section data-main><h1>Rain</h1><p>It rained for a week.</p><pre>mm 4 8 15 16 23 42</pre><p>Then the sun came out, and with it the <b>snails</b>, of which there were <i>hundreds</i> in every garden of the town.</p><figure><img src="r.png"><figcaption>The garden on Sunday</figcaption></figure><dl><dt>Rain</dt><dd>water that falls</dd></dl></section><section><h2>Elsewhere</h2><p><a href="/s">Snow in June</a></p><p><a href="/t">A dry well</a></p></section></body>""",
]


def _class_words(text: str) -> set[str]:
    found = set()
    for name in text.split():
        parts = [w.lower() for w in _CLASS.findall(name)]
        if not NEGATED & set(parts[:1]):
            found |= set(parts)
    return found


def _reason(page: Page, e: int) -> tuple[str, set[str]]:
    """Why an element on its own is no part of an article (empty: it may be one), and the words of
    its class and id."""
    name = page.names[e]
    if not page.attributes[e]:
        return ("header" if name == "header" else "form" if name == "form" else "part" if name in NAMES else ""), set()
    found = page.attribute(e, "class", "id", "role", "hidden", "style", "aria-hidden")
    words = _class_words(found.get("class", "")) | _class_words(found.get("id", ""))
    bad, role = words & (TEASERS if name in ("article", "main") else WORDS), found.get("role", "").lower()
    if name not in ("html", "body") and ("hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", ""))):
        return "part", words
    if name in ("header", "form"):
        return name, words
    if name in NAMES or role in ROLES:
        return ("header" if role == "banner" else "part"), words
    if bad and name not in PHRASE - {"main"}:
        return ("part" if bad & TEASERS else "header" if bad == {"header"} else "class"), words
    return "", words


def _told(page: Page) -> tuple[list[bool], list[int]]:
    """For each element whether it is no part of an article with all it holds, and the article (its
    number, 0 for none) that it is in. An article is an article element that is not in another, else
    a main element or role. What holds one is not left out for its class."""
    n = len(page.names)
    why, words, kind = [""] * n, [set()] * n, [""] * n
    for e in range(1, n):
        why[e], words[e] = _reason(page, e)
        if not why[e]:
            kind[e] = "main" if page.names[e] == "main" or page.attribute(e, "role").get("role") == "main" else "article" if page.names[e] == "article" else ""
    article_in, main_in = [False] * n, [False] * n
    for e in range(n - 1, 0, -1):
        p = page.parents[e]
        if main_in[e] or kind[e] == "main":
            main_in[p] = True
        if (article_in[e] or kind[e] == "article") and (why[e] != "part" or main_in[e]):
            article_in[p] = True
    out, article, inside = [False] * n, [0] * n, [""] * n
    for e in range(1, n):
        p = page.parents[e]
        article[e], inside[e], out[e] = article[p], inside[p], out[p]
        if out[p]:
            out[e] = not (inside[p] == "header" and page.names[e] in HEADING)
        elif kind[e] == "article" and article[p] and page.names[article[p]] == "article":
            out[e] = True  # an article in an article
        elif why[e] and not main_in[e] and (why[e] == "part" or not article_in[e]):
            out[e], inside[e] = True, "header" if why[e] == "header" and (article[p] or words[e] & OWN) else ""
        elif kind[e] == "article" or (kind[e] == "main" and not article_in[0]):
            article[e] = e
    return out, article


def _tokens(page: Page, told: tuple[list[bool], list[int]], plain: bool) -> Iterator[tuple[int, tuple | None, int, int]]:
    """(event's number, key, words, article) of a page's words and tags in order: words is 0 for a
    tag. ``plain`` hides articles. A dropped element is the key ``None``, once."""
    out, article = told
    has, n = any(article) and not plain, len(page.names)
    link, block, words, linked = [False] * n, [0] * n, [0] * n, [0] * n
    for e in range(1, n):
        name, p = page.names[e], page.parents[e]
        link[e] = link[p] or name == "a"
        block[e] = e if name in BLOCK or name in SPACED else block[p]
    counted = [len(text.split()) if text and not out[e] else 0 for _, e, text in page.events]
    for (_, e, _), k in zip(page.events, counted):
        words[block[e]] += k
        linked[block[e]] += k * link[e]
    for i, ((kind, e, _), k) in enumerate(zip(page.events, counted)):
        if out[e]:
            if kind == OPEN and not out[page.parents[e]]:
                yield i, None, 0, article[e]
            continue
        scope, b = "in" if has and article[e] else "out" if has else "none", block[e]
        links = "links" if 2 * linked[b] > words[b] else "text" if words[b] else "empty"
        if kind in (OPEN, CLOSE):
            name = "div" if plain and page.names[e] in ("article", "main") else page.names[e]
            yield i, (scope, name if name in BLOCK or name in KNOWN else "other", links), 0, article[e]
        elif k:
            around = "div" if plain and page.names[b] in ("article", "main") else page.names[b]
            yield i, (scope, "words", around, links), k, article[e]


#: Inline names that are scored one by one; all others count as one.
KNOWN = frozenset("a b br cite code em i img span strong sub sup td th wbr".split())
Weights = dict[str, float]


def _key(key: tuple) -> str:
    return " ".join(str(k) for k in key)


def counts(html: str, labelled: bool) -> Counter:
    """(key, inside) of a labelled page: words and tags in and out of its main text. Where the page
    does not label itself there are none."""
    page, found = Page(html or ""), Counter()
    told, main = _told(page), [False] * len(page.names)
    if labelled:
        for e in range(1, len(page.names)):
            main[e] = main[page.parents[e]] or "data-main" in page.attribute(e, "data-main")
    else:
        main = [bool(a) for a in told[1]]
    if any(main):
        for plain in (True,) if labelled else (False, True):
            for i, key, n, _ in _tokens(page, told, plain):
                if key is not None:
                    e = page.events[i][1]
                    inside = main[e] and (n > 0 or main[page.parents[e]])
                    found[(_key(key), inside)] += max(n, 1)
    return found


def learned(seen: Counter) -> Weights:
    """Scores of words and costs of tags by key."""
    out: Weights = {}
    for key in {k for k, _ in seen}:
        a, b = seen[(key, True)] + PRIOR, seen[(key, False)] + PRIOR
        if " words " in key:
            out[key] = a / (a + b)
        else:
            out[key] = -min(MOST, LEAST + ODDS * max(0.0, math.log(b / a)))
    return out


def _score(weights: Weights, key: tuple | None) -> float:
    if key is None:
        return -DROPPED
    if key[1] != "words":
        return -LEAST if key[0] == "in" else weights.get(_key(key), -1.0)
    if key[0] == "out":
        return 0.0
    return weights.get(_key(key), 0.9 if key[0] == "in" else weights.get(f"none words div {key[3]}", 0.5))


def best(scored: Iterator[tuple[int, float, int]]) -> tuple[int, int] | None:
    """First and last event of the stretch with the largest sum over 0 (the first of equals) in
    (event, score, article); a stretch stays in one article, or outside of all."""
    top, stretch, total, start, where = 0.0, None, 0.0, 0, 0
    for i, score, article in scored:
        if total <= 0 or article != where:
            total, start, where = 0.0, i, article
        total += score
        if total > top:
            top, stretch = total, (start, i)
    return stretch


def main_text(html: str | None, weights: Weights) -> str:
    page = Page(html or "")
    out, article = told = _told(page)
    found = best((i, _score(weights, key) * (n or 1), where) for i, key, n, where in _tokens(page, told, False))
    if found is None:
        return ""
    where = article[page.events[found[0]][1]]
    blocks, held = [], []
    for kind, e, text in page.events[found[0] : found[1] + 1]:
        name = page.names[e]
        if kind not in (OPEN, CLOSE):
            if not out[e] and article[e] == where:
                held.append(text)
        elif name in BLOCK:
            blocks.append("".join(held))
            held = []
        elif name in SPACED:
            held.append(" ")
    blocks.append("".join(held))
    flat = (" ".join(references.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in flat if b)


def fit(pages: DataFrame) -> Weights:
    """Scores from ``LABELLED`` and a sample of the pages."""
    seen = Counter()
    for html in LABELLED:
        seen.update(counts(html, True))
    # so few hashes lie below the bound that the sample is chosen among a few thousand pages at any size
    share = min(1.0, OVERSAMPLED * SAMPLE / max(pages.count(), 1))
    below = pages.select("html", F.xxhash64("html").alias("_h")).filter(F.col("_h") <= int((share - 0.5) * (1 << 64) * (1 - 1e-9)))
    sample = below.filter(F.length("html") <= SAMPLE_CHARS).select("_h", "html").orderBy("_h", "html").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            for html in b.column(0).to_pylist():
                found.update(counts(html, False))
        yield pa.RecordBatch.from_pydict({"key": [k for k, _ in found], "inside": [i for _, i in found], "n": list(found.values())}, schema=pa.schema([("key", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    told = sample.select("html").mapInArrow(run, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n"))
    for r in told.collect():  # a row for each name, scope and side
        seen[(r["key"], r["inside"])] += r["n"]
    return learned(seen)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``; columns of these names
    are replaced. Weights are learned from the pages where none are given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    weights = fit(pages) if weights is None else weights
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = packed(pages.select(*[F.col(f"`{c}`") for c in names]), "html")
    schema = T.StructType([*rows.schema, T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, weights) for h in b.column(b.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema=arrow)

    return unpacked(rows.mapInArrow(run, schema), names, "text", F.length("text").cast("long").alias("n_chars"))
