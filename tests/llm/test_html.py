import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{x:"</p>"}</style><script>var a="<article>no</article>";</script></head>
<body><header><p>Site header</p></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div><!-- <p>hidden</p> -->
<main><aside>Side</aside><article id=a1><h1>Big  &lt;Title&gt;</h1><p><b>One &nbsp; two<br>three<p>Fünf &#252;&#x1F600;</p>
<div class="ad">Buy</div><ul><li>first<li>second</ul><form><input value="x"><p>Sign up</p></form><noscript>no</noscript><table><tr><td>a</td><td>b</td></tr></table>
<section id="comments"><article class="comment"><p>Me too!</p></article></section><footer>by me</footer><div hidden><p>unseen</p></div></article><p>After</p></main><footer>&copy; site</footer></body></html>"""


def test_article():
    sure, own = html.blocks(PAGE)
    assert sure and own == ["Big <Title>", "One two three", "Fünf ü😀", "first", "second", "a b"]


def test_main_where_there_is_no_article_and_broken_markup():
    assert html.blocks("<body><nav>x</nav><main><p>a<p>b</main>z") == (True, ["a", "b"])
    assert html.blocks("<div role=main><p>a</div>z") == (True, ["a"])
    for odd in ("", "<", "<p", "<!--", "<p>x<!-- y", "</p></div>x", "<script>x", "a < b && c > d", "<article>", "<p class='x>y</p>", "<p \"", "<a b='", "<p/>x"):
        html.blocks(odd)
    assert html.blocks("a < b &amp;&amp; c")[1] == ["a < b && c"]


#: (page, its main text), each written by hand.
LABELLED = [
    ('<main class="with-sidebar"><p>one</p><p>two</p></main>', "one\ntwo"),
    ('<div class="site has-sidebar"><article><p>one</p></article></div>', "one"),
    ('<article class="post comments-open"><p>one</p></article>', "one"),
    ("<main><p>an intro of several words that is the text</p><article><p>a card</p></article></main>", "an intro of several words that is the text\na card"),
    ('<article><p>one</p><div class="search-results-study"><p>two</p></div><div class="share-buttons">Share</div></article>', "one\ntwo"),
    ("<article><p>one <button>Like<p>two</p></article>", "one Like\ntwo"),
    ("<article><p>one <svg><path d='x'><p>two</p></article>", "one\ntwo"),
    ("<article><object data=x><p>two</p></article>", "two"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "so x=1 holds"),
    ("<article><p>one <button>Like</button> two <svg><text>no</text></svg></p></article>", "one two"),
    ('<form id="all"><nav>menu</nav><main><p>text of the page</p><form><p>Sign up</p></form></main></form>', "text of the page"),
    ('<div class="l-site-footer"><p>legal</p></div><div class="entry-body"><p>text</p></div><div id="cookie-banner">ok?</div>', "text"),
    ('<div role="navigation">menu</div><p data-class="ad">text</p>', "text"),
    ("<title>never closed<p>text</p>", "never closed\ntext"),
    ('<article><p title="never closed>one</p><p>two</p></article>', "one\ntwo"),
    ("<article><h1>T</h1><div class='sidebar'>x</div><blockquote>q<footer>who</footer></blockquote></article>", "T\nq"),
]


@pytest.mark.parametrize("page, text", LABELLED)
def test_labelled_pages(page, text):
    assert "\n".join(html.blocks(page)[1]) == text


@pytest.mark.parametrize("bad", ["<a " * 350_000, '<a "' * 250_000, "<b>" * 170_000 + "</i>" * 120_000, "<svg>" * 200_000, "<button>" * 120_000, "<!--" * 250_000, "<nav>" + "<article>" * 100_000, '<p class="' * 100_000 + ">", "<p>" * 300_000])
def test_time_follows_the_length(bad):
    began = time.perf_counter()
    html.blocks(bad)
    assert time.perf_counter() - began < 6


def rows(spark, pages):
    df = spark.createDataFrame([(*p, "x", "y", "z", 7) for p in pages], "page_id long, url string, html string, text string, row string, host string, shards int")
    return [(r.page_id, r.text) for r in html.extract(df).collect()]


def test_every_page_has_a_row(spark):
    pages = [(1, "http://h/1", PAGE), (2, None, None), (None, "http://h/2", ""), (1, "http://h/1", PAGE), (3, "http://h/3", f"<article><p>{'word ' * 100_000}</p></article>")]
    got = dict(rows(spark, pages[1:]))
    assert got[2] == "" and got[None] == "" and len(got[3]) == 499_999 and got[1].startswith("Big <Title>\nOne two three\n")
    assert len(rows(spark, pages)) == 5
    assert rows(spark, []) == []


def brute(pages, run=html.RUN):
    """By plain sets: the blocks that strings of ``run`` tokens cover which many of the host's distinct pages have."""
    parsed = [html.blocks(page) for _, _, page in pages]
    edge = [None] * (run - 1)
    where, distinct = defaultdict(set), defaultdict(set)
    for (_, url, _), (_, own) in zip(pages, parsed, strict=True):
        flat = [*edge, *(t for b in own for t in b.lower().split()), *edge]
        if own:
            distinct[url.split("/")[2]].add(tuple(own))
        for i in range(len(flat) - run + 1):
            where[url.split("/")[2], tuple(flat[i : i + run])].add(tuple(own))
    out = []
    for (i, url, _), (sure, own) in zip(pages, parsed, strict=True):
        host = url.split("/")[2]
        flat, gone = [*edge, *(t for b in own for t in b.lower().split()), *edge], set()
        for a in range(len(flat) - run + 1):
            n = len(where[host, tuple(flat[a : a + run])])
            if n >= (html.SURE_PAGES if sure else html.PAGES) and n > (html.SURE_SHARE if sure else html.SHARE) * len(distinct[host]):
                gone |= set(range(a, a + run))
        kept, at = [], run - 1
        for b in own:
            size = len(b.split())
            if not gone.issuperset(range(at, at + size)):
                kept.append(b)
            at += size
        out.append((i, "\n".join(kept or own)))
    return out


def site(n, boiler=True, wrap="div"):
    rng = np.random.default_rng(n)
    foot = "<p>all rights reserved by the owner of this fine site since long ago</p><p>Terms of use</p>" if boiler else ""
    top = "<ul><li>Home<li>About us<li>Contact</ul>" if boiler else ""
    pages = []
    for i in range(n):
        own = "".join(f"<p>{' '.join(rng.choice(['ka', 'lo', 'mi', 'nu', 're', 'so', 'ta', 'vu'], 12))} {i}</p>" for _ in range(3))
        pages.append((i, f"http://h{i % 2}/p/{i}", f"<{wrap}>{top}{own}<p>tail {i % 3} a b c d e f g h</p>{foot if i % 7 else ''}</{wrap}>"))
    return pages


@pytest.mark.parametrize("wrap", ["div", "article"])
def test_suffix_arrays_by_brute_force(spark, wrap):
    pages = site(60, wrap=wrap)
    got = sorted(rows(spark, pages))
    assert got == sorted(brute(pages))
    assert not any("rights reserved" in t or "About" in t or "Terms" in t for _, t in got)
    assert all(t.count("\n") in (2, 3) for _, t in got)


def test_shards_and_joined_strings_give_the_same(spark, monkeypatch):
    pages = site(400)
    whole = sorted(rows(spark, pages))
    monkeypatch.setattr(html, "SHARD_PAGES", 60)
    assert sorted(rows(spark, pages)) == whole
    monkeypatch.setattr(html, "BROADCAST_RUNS", 0)
    assert sorted(rows(spark, pages)) == whole


def test_suffix_ranks_are_the_order_of_prefixes():
    rng = np.random.default_rng(4)
    h, page = rng.integers(0, 3, 200).astype(np.uint64), np.repeat(np.arange(4), 50)
    rank = html.suffix_ranks(h, page, 8)
    own = [tuple(int(x) + 1 for x in h[i : min(i + 8, (page[i] + 1) * 50)]) for i in range(200)]
    order = {x: k + 1 for k, x in enumerate(sorted(set(own)))}
    assert rank.tolist() == [order[x] for x in own]
    assert html.streams(pa.array(["", "a"]), np.array([0, 1]))[1].tolist() == [1] * 15


def test_copied_articles_stay(spark):
    same = "<article><p>" + "a copied article of many words " * 20 + "</p></article>"
    got = rows(spark, [(i, "http://h/x", same) for i in range(5)])
    assert len(got) == 5 and len({t for _, t in got}) == 1 and got[0][1] != ""


def test_copied_and_quoting_pages_without_structure_stay(spark):
    foot = "<p>all rights reserved by the owner of this fine site since long ago</p>"
    own = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(30)]
    quote = "a sentence that two posts quote in full at their very start"
    own[3], own[4] = f"{quote} {own[3]}", f"{quote} {own[4]}"
    alone = "<p>" + "a copied page without any structure " * 9 + "</p>"
    pages = [(i, f"http://h/{i}", f"<div><p>{t}</p>{foot}</div>") for i, t in enumerate(own)]
    pages += [(50 + i, f"http://h/c{i}", f"<div><p>{own[5]}</p>{foot}</div>") for i in range(40)]
    pages += [(100 + i, f"http://g/{i}", alone) for i in range(3)]
    got = dict(rows(spark, pages))
    assert all(got[i] == t for i, t in enumerate(own)) and all(got[50 + i] == own[5] for i in range(40))
    assert all(got[100 + i] == ("a copied page without any structure " * 9).strip() for i in range(3))
