"""Records with line breaks in quoted fields, read by many tasks."""

from __future__ import annotations

import contextlib
import csv
import io
import os
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freightlens.sources import records
from freightlens.sources.records import STAYS_IN, STAYS_OUT, fields_of, read_records


@contextlib.contextmanager
def splits_of(spark, n_bytes):
    """Blocks of about ``n_bytes``."""
    keys = {"spark.sql.files.maxPartitionBytes": str(n_bytes), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _file(path, rows, line_end, quote=csv.QUOTE_ALL):
    out = io.StringIO()
    csv.writer(out, quoting=quote, lineterminator=line_end).writerows(rows)
    with open(path, "wb") as fh:
        fh.write(out.getvalue().encode("latin-1"))


def _python(path):
    with open(path, encoding="latin-1", newline="") as fh:
        return [tuple(r) for r in csv.reader(fh) if r]


def _rows(seed, n=700):
    rng = random.Random(seed)
    parts = ["a", "b c", '"', '""', ",", "\n", "\r\n", "é", "\n\n", '",', '"\n', "x" * 40]
    return [("n", "left", "right")] + [
        (str(i), "".join(rng.choices(parts, k=rng.randint(1, 5))) + ".", "q" + "".join(rng.choices(parts, k=rng.randint(0, 9))))
        for i in range(n)
    ]


def _got(spark, path, names=("n", "left", "right")):
    found = read_records(spark, path, "ISO-8859-1").orderBy("file", "block", "pos")
    found = found.select("block", "broken", fields_of(found["text"], list(names), "_torn").alias("f")).collect()
    return [tuple(r.f[c] for c in names) for r in found], len({r.block for r in found}), found


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_one_file_by_many_tasks_is_what_csv_reads(spark, tmp_dir, line_end):
    path = os.path.join(tmp_dir, "raw.csv")
    _file(path, _rows(1), line_end)
    with splits_of(spark, 2_000):
        rows, blocks, _ = _got(spark, path)
    assert blocks > 10
    assert rows == _python(path)


def test_several_files_and_little_quoting(spark, tmp_dir):
    for k in range(4):
        _file(os.path.join(tmp_dir, f"part-{k}.csv"), _rows(k, 60 * k), "\n", csv.QUOTE_MINIMAL)
    with splits_of(spark, 1_500):
        rows, _, _ = _got(spark, tmp_dir)
    assert rows == [r for k in range(4) for r in _python(os.path.join(tmp_dir, f"part-{k}.csv"))]


def test_a_long_field_and_an_open_quote(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    long = "line of a long field\n" * 60
    with open(path, "w") as fh:
        fh.write(f'1,"{long}",x\n2,"b",y\n3,"never closed\nand on\n' + "so on\n" * 400)
    with splits_of(spark, 3_000):
        rows, _, found = _got(spark, path)
    assert rows[:2] == [("1", long, "x"), ("2", "b", "y")]
    assert [r.broken for r in found] == [False, False, True]


def test_without_rows(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    with open(path, "w") as fh:
        fh.write("\n\n")
    assert _got(spark, path)[0] == []


def _python_state(line, inside):
    """Whether a quoted field is open after ``line``, sign by sign."""
    state = "quoted" if inside else "start"
    k = 0
    while k < len(line):
        c = line[k]
        if state == "quoted":
            if c == '"' and line[k + 1 : k + 2] == '"':
                k += 1
            elif c == '"':
                state = "field"
        elif c == ",":
            state = "start"
        elif state == "start":
            state = "quoted" if c == '"' else "field"
        k += 1
    return state == "quoted"


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list('"",,ab \r')), max_size=14))
def test_patterns_against_a_walk_over_the_line(line):
    out, within = (re.compile(p.replace("\\z", "\\Z")) for p in (STAYS_OUT, STAYS_IN))
    assert bool(out.search(line)) == _python_state(line, False)
    assert bool(within.search(line)) == _python_state(line, True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=12), st.booleans())
def test_states_after_lines(maps, state):
    import numpy as np

    got = records._after(state, np.array([m[0] for m in maps]), np.array([m[1] for m in maps]))
    for (from_out, from_in), after in zip(maps, got.tolist()):
        state = from_in if state else from_out
        assert after == state


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', ",", "x", "é", "\r", " "]), max_size=8).map("".join))
def test_lines_that_need_no_pattern(line):
    """What their last characters tell is what the patterns tell."""
    as_python = lambda p: re.compile(p.replace("\\z", "\\Z"))
    maps = tuple(bool(as_python(p).search(line)) for p in (STAYS_OUT, STAYS_IN))
    if '"' not in line:
        assert maps == (False, True)
    for end in ('"', '"\r'):
        if line.endswith(end) and line != end and not line.endswith((f",{end}", f'"{end}')):
            assert maps == (False, False)


def test_records_within_blocks_are_cut_once(spark, tmp_path):
    """Without a record over the end of a block no line is cut twice."""
    path = str(tmp_path / "plain.csv")
    _file(path, _rows(3, 50), "\n")
    found = read_records(spark, path, "ISO-8859-1")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_the_raw_export_takes_little_disk(spark, monkeypatch):
    """Wide lines are not shuffled, and the export is compressed, in bounded files."""
    import glob
    import os

    from freightlens.plans import catalog
    from freightlens.plans.session import checkpoint_dir
    from tests.conftest import SF_SMALL

    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = catalog.raw_lines_by_order(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
    assert "SortMergeJoin" in plan and "REPARTITION_BY" not in plan
    monkeypatch.setattr(catalog, "EXPORT_LINES", 200)
    folder = checkpoint_dir(spark).removeprefix("file:") + "/tables/raw-export-*"
    before = set(glob.glob(folder))
    got = catalog.QUERIES["raw_csv_roundtrip"](spark, SF_SMALL)
    want = catalog.QUERIES["shipments"](spark, SF_SMALL)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    (export,) = set(glob.glob(folder)) - before
    files = glob.glob(f"{export}/part-*")
    assert len(files) > 20 and all(f.endswith(".csv.lz4") for f in files)
    plain = spark.read.text(export).selectExpr("sum(length(value) + 1)").first()[0]
    assert sum(map(os.path.getsize, files)) < plain / 2


def test_shuffles_are_removed_when_a_step_ends(spark):
    import glob
    import tempfile

    from freightlens.plans.session import shuffles_removed

    def written():
        where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in where for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}

    key, old = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", written()
    before = spark.conf.get(key, None)
    with shuffles_removed(spark):
        spark.range(1000).repartition(5, "id").write.parquet(tempfile.mkdtemp() + "/out")
    for _ in range(50):
        if not written() - old:
            break
        time.sleep(0.2)
    assert not written() - old and spark.conf.get(key, None) == before
