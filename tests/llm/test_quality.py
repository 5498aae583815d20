from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from freightlens.llm import queries, quality
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = {}
    for i in range(len(ws) - 4):
        windows.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(ws), len(covered)
    return (
        n,
        sum(map(len, ws)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        rep,
        n < 10 or 100 * rep > 20 * n,
    )


def rows_of(spark, texts):
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in enumerate(texts)],
        "doc_id long, text string, n_words string, fails int",
    )
    return {r.id: r for r in quality.judge(docs).collect()}


def test_base_against_brute_force_on_the_table(spark):
    docs = queries.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op7_line_quality(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert found == base(d.text), d.doc_id
        assert not (r.base_failed and r.kept)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n\t\x0b\xa0é#", max_size=80), min_size=1, max_size=12))
def test_base_on_any_text(spark, texts):
    got = rows_of(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert found == base(t), t


def test_null_empty_and_long(spark):
    long = " ".join(f"word{i % 9000}." for i in range(20_000))
    got = rows_of(spark, [None, "", long])
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[1].n_words == 0 and got[1].cleaned_text == ""
    assert got[2].n_words == 20_000 and got[2].n_repeat_words == base(long)[4]


def test_line_rules(spark):
    prose = "This is a plain sentence of prose that says one thing, and then it stops here."
    nav = "Home | About us | News | Contact | Shop | Help"
    spam = "We use cookies to improve your stay on this site."
    runon = " ".join(f"token{i}" for i in range(30))
    junk = "buy*** now### cheap$$$ pills%%% here&&& today***"
    title = "A short heading"
    text = "\n".join([title, prose, nav, spam, prose + " Again.", runon, junk, prose])
    r = rows_of(spark, [text, "\n".join([nav, runon]), prose])
    assert r[0].n_lines_failed == 4
    assert r[0].cleaned_text == "\n".join([title, prose, prose + " Again.", prose])
    assert not r[1].kept and not r[1].base_failed
    assert r[2].kept and r[2].cleaned_text == prose


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(docs).collect() == []
