from __future__ import annotations

import numpy as np
import pytest

from freightlens.llm import nn_descent, queries
from tests.conftest import SF_SMALL


def brute(rows, threshold=0.95):
    """{id: (links, component)} by comparing all pairs."""
    usable = []
    for i, v in rows:
        if v is None or any(c is None for c in v):
            continue
        x = np.array(v, float)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            usable.append((i, x / np.linalg.norm(x)))
    links = {i: 0 for i, _ in rows}
    up = {i: i for i, _ in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (a, x) in enumerate(usable):
        for b, y in usable[:k]:
            if a != b and len(x) == len(y) and float(x @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                r, s = find(a), find(b)
                up[max(r, s)] = min(r, s)
    return {i: (links[i], find(i)) for i, _ in rows}


def got(spark, rows):
    vectors = spark.createDataFrame(
        [(v, i, "x", 1) for i, v in rows], "embedding array<float>, vec_id long, x string, dim int"
    )
    out = nn_descent.near_vectors(vectors).collect()
    assert len(out) == len(rows)
    return {r.id: (r.n_links, r.component_id) for r in out}


def cloud(rng):
    f = lambda x: [float(np.float32(c)) for c in x]
    rows = [(i, f(rng.normal(size=24))) for i in range(500)]
    for i in range(500, 560):  # twins of earlier vectors
        rows.append((i, f(np.array(rows[i - 500][1]) + rng.normal(size=24) * 0.05)))
    centre = rng.normal(size=24) * 2
    for i in range(600, 900):  # one dense group, partly at the edge of the threshold
        rows.append((i, f(centre + rng.normal(size=24) * rng.choice([0.05, 0.45]))))
    line = rng.normal(size=24)
    for i in range(900, 930):  # a chain: near its neighbours, far from its ends
        line = line + rng.normal(size=24) * 0.15
        rows.append((i, f(line)))
    return rows


def test_against_all_pairs(spark):
    rows = cloud(np.random.default_rng(4))
    want, found = brute(rows), got(spark, rows)
    true, seen = sum(n for n, _ in want.values()), sum(n for n, _ in found.values())
    assert all(found[i][0] <= want[i][0] for i in want)
    assert seen >= 0.98 * true
    same = sum(found[i][1] == want[i][1] for i in want)
    assert same >= 0.98 * len(rows)


def test_dense_group_counts_in_tiles(spark):
    old, nn_descent.TILE = nn_descent.TILE, 16
    try:
        rows = [r for r in cloud(np.random.default_rng(9)) if r[0] >= 600 and r[0] < 700]
        want, found = brute(rows), got(spark, rows)
    finally:
        nn_descent.TILE = old
    assert {i: n for i, (n, _) in found.items()} == {i: n for i, (n, _) in want.items()}


def two_groups(rng, size, spread):
    """Near copies around two centres with a cosine of 0.96."""
    a, b = np.eye(24)[:2]
    b = 0.96 * a + np.sqrt(1 - 0.96**2) * b
    rows = [list(map(float, rng.normal(size=24))) for _ in range(200)]
    rows += [list(map(float, c + rng.normal(size=24) * spread)) for c in (a, b) for _ in range(size)]
    return [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(rows)]


def test_links_between_saturated_groups(spark):
    for spread in (0, 1e-3):
        rows = two_groups(np.random.default_rng(3), 20, spread)
        want = brute(rows)
        assert want[200] == (39, 200) and want[239] == (39, 200)
        assert got(spark, rows) == want


def test_audit_sees_what_is_missed(spark, monkeypatch):
    rows = two_groups(np.random.default_rng(5), 150, 1e-3)
    rows += [(1000 + i, [c + 1e-4 for c in x]) for i, x in rows[:100]]  # twins
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    units = nn_descent.unit_vectors(vectors, "vec_id", "embedding")
    nodes, holders = nn_descent._nodes(units)
    ids = {r.id: r.node for r in holders.collect()}
    hot = [(ids[i], 1, 299) for i in range(200, 500)]  # the large group only
    components = spark.createDataFrame([(n, c) for n, c, _ in hot], "node long, component long")
    counts = spark.createDataFrame([(n, k) for n, _, k in hot], "id long, n_links long")
    audited = nn_descent.audit(nodes, holders, components, counts, 0.95)
    assert audited["large"][2] == 1.0 and audited["small"][2] == 0.0 and not nn_descent._passed(audited)
    assert not nn_descent._passed({})

    monkeypatch.setattr(nn_descent, "audit", lambda *a: audited)
    monkeypatch.setattr(nn_descent, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        nn_descent.near_vectors(vectors)


def test_trees_and_crowded_cells(spark, monkeypatch):
    for bits in (6, 12, 17):  # a pair at the threshold meets in one of the trees
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** nn_descent._trees_for(bits, 0.95) <= nn_descent.MISS
    # Vectors at right angles in one crowded cell are parted by hyperplanes.
    monkeypatch.setattr(nn_descent, "CELL", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=24)]) for i in range(600)]
    units = nn_descent._nodes(nn_descent.unit_vectors(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v"))[0]
    cells = nn_descent._cells(units.withColumn("grp", units["id"]), 1 + 12, range(1))
    dealt, deepest = nn_descent._dealt(cells, 1)
    sizes = [r["count"] for r in dealt.groupBy("tree", "dim", "depth", "cell").count().collect()]
    assert deepest > 1 and sum(sizes) == 600 and max(sizes) <= 64


def test_ids_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])]
    vectors = spark.createDataFrame(
        [(v, i, "x", 1) for i, v in rows], "embedding array<float>, vec_id long, x string, dim int"
    )
    out = {r.id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(vectors).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (1, 1)}


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (11, [1e-30, 2e-30]),
    ]
    assert got(spark, rows) == brute(rows)
    assert brute(rows)[7] == (2, 7)


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_query_on_the_table(spark):
    rows = queries.table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding").collect()
    out = queries.op4_nn_descent(spark, SF_SMALL).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute([tuple(r) for r in rows])
