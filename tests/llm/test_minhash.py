from __future__ import annotations

import random
import re

import numpy as np
import pytest

from freightlens.llm import minhash, queries, shingles
from tests.conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(ws) < n:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(rows, n, percent):
    """{id: (n_shingles, component)} by comparing all pairs."""
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = find(a), find(b)
                up[max(r, s)] = min(r, s)
    return {(d, len(s), find(d)) for d, s in sets}


def got(spark, rows, n, percent):
    docs = spark.createDataFrame(
        [(t, d, "v") for d, t in rows], "text string, doc_id long, sketch string"
    )
    out = minhash.near_duplicates(docs, n=n, percent=percent).collect()
    assert len(out) == len(rows)
    return {(r.id, r.n_shingles, r.component_id) for r in out}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 4000}"
    rows = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(150)]
    passage = [word() for _ in range(60)]
    for _ in range(60):  # a shared passage in otherwise different texts
        rows.append(" ".join(passage + [word() for _ in range(rng.randint(5, 80))]))
    base = [word() for _ in range(150)]
    for _ in range(80):  # one large group of near copies, some just out of reach
        rows.append(edited(rng, base, rng.randint(0, 8)))
    rows += [rows[3].upper(), rows[3], "a b", "A  b", "a", None, "", " \t\n"]
    return list(enumerate(rows))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, n, percent):
    rows = corpus(random.Random(n))
    assert got(spark, rows, n, percent) == brute(rows, n, percent)


def test_query_on_the_table(spark):
    docs = queries.table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    want = brute([(d.doc_id, d.text) for d in docs], 3, 85)
    out = queries.op3_minhash(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_repeated_ids_and_missing_ids(spark):
    t1, t2 = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, t1), (5, t2), (3, t2), (9, t1), (None, t1), (7, None), (5, t1)]
    assert got(spark, rows, 3, 85) == {(5, 4, 3), (3, 4, 3), (9, 4, 3), (None, 4, None), (7, 0, 7)}


def test_empty_table(spark):
    assert got(spark, [], 3, 85) == set()


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "x y"), (4, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.deduplicated(docs).collect()) == [1, 3, 4, 5]


def test_words_of_slices_and_long_words():
    import numpy as np

    old, shingles.SLICE = shingles.SLICE, 64
    try:
        rng = random.Random(1)
        text = "".join(rng.choice("abcdeé \n") for _ in range(3000)) + "x" * 500 + " tail"
        sliced = shingles.word_hashes(np.frombuffer(text.encode(), np.uint8))
    finally:
        shingles.SLICE = old
    whole = shingles.word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert (sliced == whole).all() and len(whole) == len(text.split())
    assert len(set(whole.tolist())) == len(set(text.split()))


def test_long_words_of_a_known_colliding_family():
    """The two sequences of Thue and Morse have equal polynomials modulo 2**64."""
    turn, other = bytearray(b"a"), bytearray(b"b")
    for _ in range(12):
        turn, other = turn + other, other + turn
    data = np.frombuffer(bytes(turn) + b" " + bytes(other) + b" " + bytes(turn).upper(), np.uint8)
    first, second, again = shingles.word_hashes(data)
    assert first != second and first == again
    long = shingles.LONG
    for n in (long, long + 1):  # where the hash of a word changes: equal words stay equal
        data = np.frombuffer(b"x" * n + b" " + b"X" * n + b" " + b"x" * (n - 1) + b"y", np.uint8)
        a, b, c = shingles.word_hashes(data)
        assert a == b and a != c
