from __future__ import annotations

import random
import uuid

import numpy as np
import pyarrow as pa
import pytest

from freightlens.llm import queries, token_scan
from tests.conftest import SF_SMALL

END = token_scan.END_OF_DOCUMENT


def brute(ids):
    """(ordinal, start, n_tokens, closed) of a file's documents."""
    out, start = [], 0
    for at, i in enumerate(ids):
        if i == END:
            out.append((len(out), start, at - start, True))
            start = at + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


def test_blocks_are_stitched(spark, tmp_dir):
    rng = np.random.default_rng(6)
    files = {
        "part-00000-a": rng.choice([1, 2, END], 400, p=[0.5, 0.4, 0.1]),
        "part-00001-a": np.r_[np.full(100, 7), END, END, np.full(90, 8)],
        "part-00002-a": np.array([END]),
        "part-00003-a": np.array([0x50C4, 0xC450, 0x50, END, 0xC4]),  # its bytes also off by one
        "part-00004-a": np.full(33, 3),
        "part-00005-a": np.array([], int),
    }
    for name, ids in files.items():
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(ids.astype("<u2").tobytes())
    old, token_scan.BLOCK = token_scan.BLOCK, 16
    try:
        got = token_scan.count_tokens(spark, tmp_dir).collect()
    finally:
        token_scan.BLOCK = old
    for name, ids in files.items():
        own = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in got if r.file.endswith(name))
        assert own == brute(ids.tolist()), name


def test_query_on_the_table(spark):
    enc = token_scan.encoding(queries.BYTE_RANKS)
    docs = queries.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in queries.op6_token_scan(spark, SF_SMALL).collect()}
    assert got == {d.doc_id: len(enc.encode_ordinary(d.text or "")) for d in docs}


def tokens_of(text):
    return len(token_scan.encoding(queries.BYTE_RANKS).encode_ordinary(text or ""))


@pytest.mark.parametrize("dealt", ["repartition", "sample", "join", "one long task"])
def test_any_input_keeps_its_ids(spark, dealt):
    docs = queries.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    if dealt == "repartition":
        docs = docs.repartition(7)
    elif dealt == "sample":
        docs = docs.sample(0.5).repartition(3)  # another sample each time it is read
    elif dealt == "join":
        docs = docs.join(docs.select("doc_id").where("doc_id % 3 > 0").repartition(5), "doc_id")
    else:
        docs = docs.coalesce(1)
    want = {r.doc_id: tokens_of(r.text) for r in queries.table(spark, SF_SMALL, "documents").collect()}
    out = token_scan.document_tokens(docs, queries.BYTE_RANKS, f"dealt-{uuid.uuid4().hex}").collect()
    assert len(out) > len(want) // 3 and len({r.id for r in out}) == len(out)
    assert [r for r in out if r.n_tokens != want[r.id]] == []


def test_tasks_that_meet_rows_in_another_order(spark):
    """Rows come in another order each time a task runs, as after a lost shuffle."""
    rows = [(i, "word " * i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    seen = docs.count()

    def shuffled(batches):
        rng = random.Random()
        for batch in batches:
            order = list(range(batch.num_rows))
            rng.shuffle(order)
            yield batch.take(pa.array(order))

    out = token_scan.document_tokens(
        docs.mapInArrow(shuffled, docs.schema), queries.BYTE_RANKS, f"order-{uuid.uuid4().hex}"
    ).collect()
    docs.unpersist()
    assert len(out) == seen == 300
    assert [r for r in out if r.n_tokens != tokens_of("word " * r.id)] == []


def test_files_are_bounded_and_long_texts_whole(spark):
    old, token_scan.FILE_BYTES = token_scan.FILE_BYTES, 400
    try:
        rows = [(i, "word " * (i % 90)) for i in range(100)] + [(100, "long text " * 60_000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        name = f"bounded-{uuid.uuid4().hex}"
        out = token_scan.document_tokens(docs, queries.BYTE_RANKS, name).collect()
    finally:
        token_scan.FILE_BYTES = old
    want = {i: tokens_of(text) for i, text in rows}
    assert {r.id: r.n_tokens for r in out} == want
    assert len({r.file for r in out}) > 5
    sizes = {}
    for r in out:
        sizes.setdefault(r.file, []).append(2 * r.n_tokens + 2)
    assert all(sum(s) - s[-1] < 400 for s in sizes.values() if len(s) > 1)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "some words here", 9), (3, "some words here", 9), (None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ordinal int").coalesce(2)
    out = token_scan.document_tokens(docs, queries.BYTE_RANKS, f"odd-{uuid.uuid4().hex}").collect()
    assert sorted((r.id or 0, r.n_tokens) for r in out) == [(0, 1), (1, 0), (2, 0), (3, 3), (3, 3)]
    none = token_scan.document_tokens(docs.limit(0), queries.BYTE_RANKS, f"none-{uuid.uuid4().hex}").collect()
    assert none == []


def test_files_are_read_in_pieces(spark, tmp_dir):
    """No row holds a file, wherever its splits, its blocks and its documents end."""
    rng = np.random.default_rng(7)
    files = {
        "part-00000-a": rng.choice([1, 0x50C4, 0xC450, 0x50, 0xC4, END], 3000, p=[0.3, 0.2, 0.1, 0.2, 0.1, 0.1]),
        "part-00001-a": np.r_[[0xBBEF, 0x50BF, 0xC4, 5, END], rng.choice([7, 0x5000, 0xC4, END], 3000)],
        "part-00002-a": np.array([0xBBEF, 0x00BF, 9]),  # two ids with the bytes of a mark
        "part-00003-a": np.full(2000, END),
        "part-00004-a": np.r_[np.full(5000, 3), END, 4],
    }
    for name, ids in files.items():
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(ids.astype("<u2").tobytes())
    old, token_scan.BLOCK = token_scan.BLOCK, 100
    asked = {"spark.sql.files.maxPartitionBytes": "301", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        scanned = token_scan.scan_blocks(spark, tmp_dir)
        got = token_scan.count_tokens(spark, tmp_dir).collect()
        splits = scanned.groupBy("file").agg({"at": "max", "n_bytes": "max"}).collect()
    finally:
        token_scan.BLOCK = old
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, ids in files.items():
        own = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in got if r.file.endswith(name))
        assert own == brute(ids.tolist()), name
    assert max(r["max(at)"] for r in splits) > 0
    most = {r.file[-12:]: r["max(n_bytes)"] for r in splits}
    assert most.pop("part-00004-a") == 10_002 and max(most.values()) < 700  # one long document


def test_an_odd_byte_is_an_error(spark, tmp_dir):
    with open(f"{tmp_dir}/part-00000-a", "wb") as f:
        f.write(b"\1\0\2")
    with pytest.raises(Exception, match="odd number of bytes"):
        token_scan.count_tokens(spark, tmp_dir).collect()
