from __future__ import annotations

import random

from freightlens.llm.line_dedup import dedup_documents, drop_repeated_lines, line_key


def brute(rows, min_chars=10):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = line_key(line)
            if doc is not None and len(k) >= min_chars:
                held.setdefault(k, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if doc is None
            or len(line_key(x)) < min_chars
            or len(held[line_key(x)]) < 2
            or min(held[line_key(x)]) == doc
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame(
        [(t, d, "a", "b") for d, t in rows], "text string, doc_id long, h string, drops string"
    )
    out = drop_repeated_lines(docs).collect()
    return sorted(((r.id, r.n_lines, r.n_dropped, r.kept_text) for r in out), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"Line number {i} of the pool" for i in range(15)] + ["short", "", " \t"]
    rows = [
        (i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 9))))
        for i in range(120)
    ]
    rows += [(200, None), (201, ""), (7, "LINE number 3 OF the pool"), (None, pool[0]), (None, None)]
    rows += [(5, rows[5][1])]  # a repeated row
    assert got(spark, rows) == brute(rows)


def test_one_very_common_line_and_a_long_text(spark):
    long = "\n".join(f"unique line {i} of the long text" for i in range(20_000))
    rows = [(i, f"the very common line\nown line of {i} here") for i in range(300)] + [(999, long)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a common line here\nmine", "en", "s", 23, "x"), (2, "A common line here", "en", "s", 18, "y"),
         (3, None, None, None, None, None), (4, "a common line here\nanother", "en", "s", 26, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, kept_text string",
    )
    out = dedup_documents(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {1, 3, 4}  # 2 has no line left
    assert rows[4].text == "another" and rows[4].n_chars == 7 and rows[4].kept_text == "z"
    assert rows[1].text == "a common line here\nmine"
