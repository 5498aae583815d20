from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from freightlens.llm import queries
from tests.conftest import SF_SMALL
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_quality import base


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL).cache()
        out.append(docs.collect())
    return out


def test_quality_stage(stages):
    before = {r.doc_id: r for r in stages[0]}
    after = {r.doc_id: r for r in stages[1]}
    assert 0.5 * len(before) < len(after) < len(before)
    for i, r in before.items():
        if base(r.text)[5]:
            assert i not in after
        elif r.text.count(".") * 12 > len(r.text.split()) and "|" not in r.text and "***" not in r.text:
            assert i in after
    for i, r in after.items():
        assert set(r.text.split("\n")) <= set(before[i].text.split("\n")) and r.n_chars == len(r.text)


def test_line_stage(stages):
    want = {}
    for doc, _, dropped, kept in brute_lines([(r.doc_id, r.text) for r in stages[1]]):
        if not dropped or kept.strip(" \t\n\x0b\x0c\r"):
            want[doc] = kept
    assert {r.doc_id: r.text for r in stages[2]} == want


def test_near_stage(stages):
    found = brute_near([(r.doc_id, r.text) for r in stages[2]], 5, 80)
    assert {r.doc_id for r in stages[3]} == {d for d, _, c in found if d == c}


def test_mix_stage_only_repeats_rows(stages):
    before = {r.doc_id: r for r in stages[3]}
    counts = Counter(r.doc_id for r in stages[4])
    assert set(counts) <= set(before) and max(counts.values()) <= 2
    assert all(r == before[r.doc_id] for r in stages[4])


def test_last_stage(stages):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    texts = {r.doc_id: r.text for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        ids = model.encode(texts[r.doc_id])
        assert r.ids == ids
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, out)) == sorted(map(key, stages[5]))
    for docs in (stages[1], stages[2], stages[3], stages[4]):
        assert list(docs[0].asDict()) == list(stages[0][0].asDict())


def test_empty_documents(spark):
    docs = queries.table(spark, SF_SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.collect() == []
