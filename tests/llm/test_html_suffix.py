from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pandas as pd

import pytest

from freightlens.llm import html_suffix, queries
from tests.conftest import SF_SMALL


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, keys int")
    out = html_suffix.main_texts(pages).collect()
    assert len(out) == len(rows)
    return {r.id: r.text for r in out}


@pytest.mark.parametrize("sf_dir", [SF_SMALL, "/root/testdata/sf0.1"])
def test_query_on_the_table(spark, sf_dir):
    pages = queries.table(spark, sf_dir, "pages").select("page_id", "html").collect()
    got = {r.page_id: r for r in queries.op8_html_text(spark, sf_dir).collect()}
    for p in pages:
        inner = re.search(r"(?s)<article>(.*?)</article>", p.html)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        want = "\n".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_structure():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="has-menu">
    <header>Site</header><nav><ul><li>Home</ul></nav><div class="cookie-notice"><p>Cookies</div>
    <main><article><header><h1>A &lt;title&gt;</h1></header><p>One &amp; <a href="x">two</a>,<br>three
    <p>Four<script>var a = "<p>no</p>";</script> five<!-- no --><span class="ad">no</span> six
    <table><tr><td>x<td>y</table><aside>no</aside><form>no<input value=">"></form>
    <section id="comments"><p>no</p></section><p hidden>no</p></article></main>
    <div id="sidebar">no</div><footer>&copy; no</footer>"""
    text, others = html_suffix.page_blocks(page)
    assert text == ["A <title>", "One & two, three", "Four five six", "x", "y"]
    assert others == []


def test_self_closed_foreign_elements():
    page = "<article><p>One <svg viewBox='0 0 1 1'/> two</p><math/><p>three <svg><text>no</text></svg> four</p></article>"
    assert html_suffix.page_blocks(page)[0] == ["One two", "three four"]


def test_layout_classes_and_named_articles():
    for name in ("wrapper has-sidebar", "no-sidebar", "with-comments", "social-science", "search-results"):
        page = f'<body><div class="{name}"><article><p>The text</p></article></div>'
        assert html_suffix.page_blocks(page)[0] == ["The text"], name
    for name in ("has-sidebar", "no-sidebar", "with-comments"):
        assert html_suffix.page_blocks(f'<div class="{name}"><p>The text</p></div>')[1] == ["The text"]
    out = '<div class="site-footer">no</div><div class="cookie-notice">no</div>'
    assert html_suffix.page_blocks(out) == ([], [])
    page = '<div><p>The text</p></div><div><article class="comment"><p>no</p></article></div>'
    assert html_suffix.page_blocks(page) == ([], ["The text"])
    page = '<article><p>The text</p></article><div class="related"><article>no</article></div>'
    assert html_suffix.page_blocks(page) == (["The text"], [])


def test_hosts_decide_where_pages_do_not(spark):
    menu = "<div>Start News Weather Sports Culture Travel Money Games Letters</div>"
    end = "<div>Written by the people of this site for all who read it</div>"
    own = {i: f"<p>Story {i} tells what happened on day {i} in town {i}.</p><p>Tail {i}</p>" for i in range(8)}
    copy = "<p>A story that stands on one page and its copies only, word for word.</p>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{menu}{own[i]}{end}", "t", 1) for i in range(8)]
    rows += [(20 + i, f"http://h.example/c{i}", f"<body>{copy}", "t", 1) for i in range(4)]
    rows += [(30, "http://other.example/", f"<body>{menu}{own[0]}", "t", 1)]
    rows += [(40, None, None, "t", 1), (41, "http://h.example/e", "", "t", 1), (42, None, "plain &amp; text", "t", 1)]
    got = texts(spark, rows)
    for i in range(8):
        assert got[i] == f"Story {i} tells what happened on day {i} in town {i}.\nTail {i}"
    assert {got[20 + i] for i in range(4)} == {copy[3:-4]}
    assert got[30].startswith("Start News")
    assert got[40] == got[41] == "" and got[42] == "plain & text"


def test_hosts_decide_in_articles_too(spark):
    notice = "<div>Read this every day and tell your friends about us please</div>"
    story = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(5)]
    rows = [(i, f"http://h.org/{i}", f"<article><p>{story[i]}</p>{notice}</article>", "t", 1) for i in range(5)]
    copy = " ".join(f"c{k}" for k in range(40))
    rows += [(10 + i, f"http://c.org/{i}", f"<article><p>{copy}</p></article><p>{i}</p>", "t", 1) for i in range(4)]
    rows += [(20, "http://p.org/", f"<div>{story[0]}</div><article>A teaser</article>", "t", 1)]
    got = texts(spark, rows)
    assert [got[i] for i in range(5)] == story
    assert {got[10 + i] for i in range(4)} == {copy}
    assert got[20] == story[0] + "\nA teaser"


def test_repeated_paragraphs_of_articles_stay(spark):
    line = "The same line of prose stands in the articles of many pages of this host."
    rows = [(i, f"http://h.org/{i}", f"<article><h1>T{i}</h1><p>{line}</p><p>Les.</p><p>Own {i}</p></article>", "t", 1)
            for i in range(6)]
    got = texts(spark, rows)
    assert {i: t for i, t in got.items()} == {i: f"T{i}\n{line}\nLes.\nOwn {i}" for i in range(6)}


def test_suffix_ranks_and_runs_against_brute_force():
    rng = random.Random(7)
    for _ in range(30):
        tokens = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 60))], np.int64)
        rank = html_suffix._suffix_ranks(tokens, 8)
        want = [tuple(tokens[i : i + 8]) for i in range(len(tokens))]
        order = {w: k for k, w in enumerate(sorted(set(want)), 1)}
        assert rank.tolist() == [order[w] for w in want]
    pages = [[rng.randint(0, 1) for _ in range(rng.randint(0, 40))] for _ in range(12)]
    for shards, least in ((1, html_suffix.MIN_PAGES), (2, 1)):
        frame = pd.DataFrame({"host": "h", "shards": shards, "tokens": pages})
        got = html_suffix._shard_runs(frame)
        held = Counter(r for p in pages for r in {tuple(p[k : k + 8]) for k in range(len(p) - 7)})
        key = lambda run: html_suffix._run_keys(np.array(run, np.int64).view(np.uint64))[0]
        want = {(key(run), n) for run, n in held.items() if n >= least}
        assert set(zip(got["key"], got["pages"])) == want


def test_shards_agree_with_one(spark):
    menu = " ".join(f"menu{k}" for k in range(12))
    rows = [(i, "http://h.example/", f"<div>{menu}</div><p>page {i} has {i} own words here</p>", "t", 1) for i in range(60)]
    whole = texts(spark, rows)
    old, html_suffix.SHARD_TOKENS = html_suffix.SHARD_TOKENS, 100
    try:
        dealt = texts(spark, rows)
    finally:
        html_suffix.SHARD_TOKENS = old
    assert whole == dealt and whole[3] == "page 3 has 3 own words here"


def test_empty_table_and_long_page(spark):
    assert texts(spark, []) == {}
    long = "<article>" + "".join(f"<p>Paragraph {i} &eacute;</p>" for i in range(20_000)) + "</article>"
    got = texts(spark, [(1, "http://x/", long, "t", 1), (1, "http://x/", long, "t", 1)])
    assert got[1].count("\n") == 19_999 and got[1].endswith("19999 é")
