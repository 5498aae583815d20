from __future__ import annotations

import re

import pytest

from freightlens.llm import mixing, queries
from tests.conftest import SF_SMALL


def fill(sizes, weights, budget, cap):
    """Water level by trying every clamped prefix."""
    n = len(sizes)
    full = [cap * s for s in sizes]
    done = set()
    while True:
        free = [i for i in range(n) if i not in done]
        if not free:
            return full
        level = (budget - sum(full[i] for i in done)) / sum(weights[i] for i in free)
        more = {i for i in free if full[i] <= level * weights[i]}
        if not more:
            return [full[i] if i in done else level * weights[i] for i in range(n)]
        done |= more


def docs_of(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, size string, target int, weight int"
    )


def test_query_targets_and_totals(spark):
    docs = queries.table(spark, SF_SMALL, "documents").select("doc_id", "text", "source").collect()
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    sources = sorted({d.source for d in docs if d.source is not None})
    total = {s: sum(size[d.doc_id] for d in docs if d.source == s) for s in sources}
    weights = [(5, 2, 1)[i % 3] for i in range(len(sources))]
    want = dict(zip(sources, fill([total[s] for s in sources], weights, 1.5 * sum(size.values()), 2.0)))
    out = queries.op2_source_mix(spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    at = {d.doc_id: d.source for d in docs}
    taken = {s: 0 for s in sources}
    for r in out:
        s = at[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r["size"]
        taken[s] += r.taken
    longest = {s: max(size[d.doc_id] for d in docs if d.source == s) for s in sources}
    for s in sources:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = queries.op2_source_mix(spark, SF_SMALL).collect()
    assert sorted(again) == sorted(out)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(i, "a b c d", "x" if i % 3 else None, "s", 1, 2) for i in range(60)]
    rows += [(1, "a b c d", "x", "s", 1, 2), (None, "one two", "y", "s", 1, 2), (70, None, "z", "s", 1, 2)]
    out = mixing.mix_counts(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    z = next(r for r in out if r.id == 70)
    assert z["size"] == 0 and z.target == 0.0
    mixed = mixing.mixed_documents(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns
    assert mixed.count() == sum(r.n_copies for r in out)


def test_empty_table(spark):
    assert mixing.mix_counts(docs_of(spark, [])).collect() == []
    assert mixing.mixed_documents(docs_of(spark, [])).collect() == []


def test_budget_beyond_all_caps(spark):
    rows = [(i, "a b", "x", "s", 1, 2) for i in range(10)]
    out = mixing.mix_counts(docs_of(spark, rows), share=9.0, max_epochs=2.0).collect()
    assert {r.n_copies for r in out} == {2} and {r.target for r in out} == {40.0}


def test_many_buckets(spark):
    old, mixing.DOCS_PER_BUCKET = mixing.DOCS_PER_BUCKET, 4
    try:
        rows = [(i, "w " * (i % 7), "ab"[i % 2], "s", 1, 2) for i in range(500)]
        out = mixing.mix_counts(docs_of(spark, rows), weights=(3, 1), share=0.6).collect()
    finally:
        mixing.DOCS_PER_BUCKET = old
    for target in {r.target for r in out}:
        assert abs(sum(r["size"] * r.n_copies for r in out if r.target == target) - target) <= 6


@pytest.mark.parametrize("text", ["a b c d", "differs"])
def test_repeated_ids_meet_the_target(spark, text):
    """All but one row share an id: as equal rows, and with texts of their own."""
    rows = [(7, text if text != "differs" else f"a b c {i}", "x", "s", 1, 2) for i in range(2000)]
    rows.append((8, "one two", "x", "s", 1, 2))
    docs = docs_of(spark, rows).repartition(5)
    old, mixing.PART = mixing.PART, 300
    try:
        out = mixing.mix_counts(docs, share=1.125).collect()
        mixed = mixing.mixed_documents(docs, share=1.125).collect()
    finally:
        mixing.PART = old
    assert len(out) == 2001 and max(r.n_copies for r in out) <= 2
    target = out[0].target
    assert target == pytest.approx(1.125 * 8002)
    assert abs(sum(r["size"] * r.n_copies for r in out) - target) <= 4
    assert abs(sum(len(r.text.split()) for r in mixed) - target) <= 4
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in rows}


def test_long_texts_and_columns_without_a_hash(spark):
    rows = [(i, "word " * (200_000 if i == 3 else 5), "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "map('a', doc_id) AS labels", "array(1, 2) AS h", "doc_id AS key", "1 AS whole"
    )
    out = mixing.mix_counts(docs).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.n_copies for r in out)
    assert next(r for r in out if r.id == 3)["size"] == 200_000
