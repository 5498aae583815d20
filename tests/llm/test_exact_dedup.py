from __future__ import annotations

import hashlib
import random

import xxhash

from freightlens.llm import exact_dedup
from freightlens.llm.exact_dedup import LEAST, MOST, chunk_ends, deduplicated, exact_copies, normalised


def norm(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(norm(text), []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[norm(text)]
        keep = max((i for i in ids if i is not None), default=None)
        mark = hashlib.sha256(norm(text).encode()).hexdigest()
        out.append((doc, keep, len(ids), doc == keep, mark))
    return sorted(out, key=str)


def got(spark, rows, **more):
    docs = spark.createDataFrame(
        [(t, d, "a", "b") for d, t in rows], "text string, doc_id long, recipe string, h string"
    )
    out = exact_copies(docs, **more).collect()
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out), key=str)


def sample():
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh \nÄé漢") for _ in range(60_000))
    near = long[:30_000] + "x" + long[30_001:]
    pool = ["", "One text", "one TEXT", "ÄB", "äb", "Äb", long, near, long.upper().replace("É", "é"), long + "y"]
    rows = [(i, rng.choice(pool)) for i in range(60)]
    return rows + [(70, None), (None, "only without id"), (None, "one text"), (3, rows[3][1]), (3, "one text")]


def test_against_brute_force(spark):
    rows = sample()
    assert got(spark, rows) == brute(rows)


def test_group_of_a_third_of_the_rows(spark):
    rows = [(i, "the hot text " * 200) for i in range(500)] + [(i, f"text {i} " * 50) for i in range(500, 1500)]
    assert got(spark, rows) == brute(rows)


def test_identifiers_that_collide_are_taken_anew(spark):
    rows = sample()

    def weak(chunk, seed):  # one byte under the first two seeds
        return xxhash.xxh3_128_digest(chunk, seed=seed)[: 1 if seed < 2 else 16]

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.verified_seed(docs, identifier=weak) == 2
    assert got(spark, rows, identifier=weak) == brute(rows)


def test_chunks_follow_the_content():
    rng = random.Random(8)
    data = bytes(rng.randrange(97, 123) for _ in range(3 << 20))
    ends = chunk_ends(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(LEAST <= s <= MOST for s in sizes[:-1]) and sizes[-1] <= MOST
    moved = chunk_ends(b"inserted" + data)
    assert len({e - 8 for e in moved} & set(ends)) > 0.99 * len(ends)
    assert chunk_ends(b"") == [] and chunk_ends(b"a") == [1]
    assert chunk_ends(bytes(20_000))[-1] == 20_000


def test_chunks_of_a_slice_are_those_of_each_text():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab cé") for _ in range(rng.choice([0, 3, 300, 9000]))) for _ in range(40)]
    held = [normalised(x) for x in texts]
    assert exact_dedup._chunked(held) == [chunk_ends(x) for x in held]


def test_deduplicated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, "b", "z")], "doc_id long, text string, kept string")
    out = deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(2, "a", "y"), (3, "b", "z")]


def test_empty_table(spark):
    assert got(spark, []) == []
