from __future__ import annotations

import re

from freightlens.llm import queries, url_filter
from freightlens.llm.components import connected_components
from tests.conftest import SF_SMALL

RULES = queries.URL_RULES


def rule_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    best = None
    for pattern, verdict in RULES:
        own, _, start = pattern.partition("/")
        fits = (host == own or host.endswith("." + own)) and path.startswith("/" + start)
        if fits and (best is None or len(pattern) > len(best[0])):
            best = (pattern, verdict)
    return host, path, best


def test_query_on_the_table(spark):
    pages = queries.table(spark, SF_SMALL, "pages").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op1_url_filter(spark, SF_SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path, best = rule_of(p.url)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None)
        assert r.verdict == (best[1] if best else "allow")


def canonical(url):
    return f'<html><head><link href="{url}" rel="canonical"></head></html>'


def judged(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node string, rule int")
    return {r.id: r for r in url_filter.judge_urls(pages, RULES, **options).collect()}


def test_blocks_pass_to_aliases_and_allow_comes_first(spark):
    refresh = "<META content='0; URL=https://c.example.org/x' http-equiv=refresh>"
    rows = [
        (1, "http://a.example.org/x", canonical("https://b.example.org/x"), "n", 1),
        (2, "https://b.example.org/x#top", refresh, "n", 1),
        (3, "https://c.example.org/x", canonical("http://bad.example.net/spam"), "n", 1),
        (4, "https://example.net/en/ok", canonical("//a.example.org/x"), "n", 1),
        (5, "https://www.org/fr/ok", canonical("http://a.example.org/x"), "n", 1),
        (6, "https://d.example.org/y", canonical("/z?a=1&amp;b=2"), "n", 1),
        (7, "https://d.example.org/z?a=1&b=2", None, "n", 1),
        (8, None, canonical("http://bad.example.net/spam"), "n", 1),
        (9, "no scheme", "", "n", 1),
        (10, "http://Example.NET:80/en/", None, "n", 1),
        (11, "HTTP://X.EXAMPLE.COM/de/", None, "n", 1),
        (1, "http://a.example.org/x", None, "n", 1),
    ]
    got = judged(spark, rows)
    assert [got[i].verdict for i in (1, 2, 3)] == ["block"] * 3
    assert got[1].by_alias and got[1].rule is None
    assert (got[4].verdict, got[4].rule) == ("allow", "example.net/en/")
    assert (got[5].verdict, got[5].rule) == ("allow", "org/fr/")
    assert [got[i].verdict for i in (6, 7, 8, 9)] == ["allow"] * 4
    assert got[8].host == got[8].path == got[9].host == ""
    assert got[11].verdict == "block" and got[11].host == "x.example.com"


def test_relative_targets(spark):
    cases = [
        ("http://h.org/a/b.html", "c.html", "h.org/a/c.html"),
        ("http://h.org/a/b.html?q", "./../c/", "h.org/c/"),
        ("http://h.org/a/b/c", "../..", "h.org/"),
        ("http://h.org/a/b", "../../../x", "h.org/x"),
        ("http://h.org/a/b?q=1#f", "?p=1&amp;u=http://x/", "h.org/a/b?p=1&u=http://x/"),
        ("http://h.org/a/b?q=1", "#top", "h.org/a/b?q=1"),
        ("http://h.org", "new/p", "h.org/new/p"),
        ("http://h.org?x", "?p=1", "h.org/?p=1"),
        ("http://h.org/a", "/b/./c/../d?x=../y", "h.org/b/d?x=../y"),
        ("http://h.org/a", "https://Other.org", "other.org/"),
        ("http://h.org/a", "mailto:x", None),
        ("no scheme", "x", None),
    ]
    frame = spark.createDataFrame([(u, canonical(t)) for u, t, _ in cases], "url string, html string")
    got = frame.select(url_filter.links_in(frame["html"], frame["url"]).alias("l")).collect()
    assert [r.l for r in got] == [[w] if w else [] for _, _, w in cases]
    rows = [
        (1, "http://bad.example.net/x/y", canonical("../new"), "n", 1),
        (2, "http://bad.example.net/new", canonical("http://alias.example.edu"), "n", 1),
        (3, "http://alias.example.edu/", None, "n", 1),
    ]
    assert judged(spark, rows)[3].verdict == "block"


def test_given_edges_and_empty_table(spark):
    edges = spark.createDataFrame(
        [("http://p.example.org/", "http://q.example.org/"), ("http://q.example.org/", "http://net/")],
        "src string, dst string",
    )
    rows = [(1, "http://p.example.org/", None, "n", 1), (2, "http://r.example.org/", None, "n", 1)]
    got = judged(spark, rows, edges=edges)
    assert got[1].verdict == "block" and got[2].verdict == "allow"
    assert judged(spark, []) == {}


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    odd = [(7, 7), (None, 3), (41, None), (200, 201), (201, 200), (200, 201)]
    links = spark.createDataFrame(chain + star + odd, "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200}
    assert got == want
