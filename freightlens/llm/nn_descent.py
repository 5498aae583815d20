"""Embedding near-duplicates by NN-descent.

Equal vectors are one node, weighted with its rows, through all steps.

1. Start. Random hyperplanes deal the vectors into small cells, as many times
   over as two vectors at the threshold need to meet but for a chance of
   ``MISS``; within a cell each vector lists its nearest neighbours. Crowded
   cells are split by more hyperplanes (and more cells follow for those); what
   these do not part, close copies, is dealt on by hash.
2. Descent. Each vector's neighbours, and a sample of those that list it, are
   compared with one another; better neighbours enter the lists, until few
   entries change. Vectors travel as 32-bit floats here.
3. List entries near the threshold are verified in double precision and joined
   into components.
4. Saturated lists hold links only, so links to other groups may stand behind
   them. Their nodes get lists of neighbours outside their own component, by
   the same start and descent, until those hold no link: a link that joins two
   components is looked for past any number of closer copies, in lists of
   bounded length.
5. Within a component every link is counted, in tiles. Members within half the
   threshold's angle of the component's first vector are linked with one
   another by the triangle inequality and need no tile among themselves.
6. Audit. Vectors of ids divisible by 20 (and others, if these have too few
   links) are compared with all rows. While fewer than ``MIN_RECALL`` of those
   with links have all of them, in small components and in large ones, more
   cells and rounds follow; after ``ATTEMPTS`` the query fails with the figures.
   A sample without any link is no evidence: it does not pass either, and
   after the last attempt a warning says so.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing; so do vectors of different lengths; rows that
share an id are left out of its own links, and of their counts the largest is
the id's; a null id has no links and no component.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.components import connected_components
from freightlens.plans.session import materialise

LOG = logging.getLogger(__name__)

CELL = 256  # vectors per cell, about
TREES = 10  # at least
MISS = 1e-3
TREES_AT_ONCE = 10
STEP, SPLITS = 6, 2  # more hyperplanes for crowded cells
NEIGHBOURS = 8
ROUNDS = 8  # at most
CHANGED = 0.02  # of the entries, in a last round
TILE = 1024
BLOCK = 1024  # vectors audited at a time
BLOCKS = 16
EVIDENCE = 200  # vectors with links
LARGE = 100  # vectors of a component
MIN_RECALL = 0.98
ATTEMPTS = 5
SLACK = 1e-4  # of 32-bit similarities


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, dim, x)``: usable vectors, normalised, as the bytes of doubles."""

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, xs = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                largest = np.abs(x).max()
                if not np.isfinite(largest) or largest == 0:
                    continue
                x = x / largest
                ids.append(i)
                dims.append(len(x))
                xs.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())],
                ["id", "dim", "x"],
            )

    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    return rows.mapInArrow(normalise, "id long, dim int, x binary")


def _nodes(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, dim, x, w, first)``, one row for each different vector with its
    rows and least id, and ``(id, node, own)``: the vectors of each id."""
    spark = units.sparkSession
    node = F.xxhash64("dim", "x")
    nodes = units.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("first"))
    nodes = materialise(spark, nodes.select(node.alias("id"), "dim", "x", "w", "first"), "nn-nodes")
    holders = units.select("id", node.alias("node")).groupBy("id", "node").agg(F.count(F.lit(1)).alias("own"))
    return nodes, materialise(spark, holders, "nn-holders")


def _stack(xs, dtype=np.float64) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype) for x in xs])


def _trees_for(bits: int, threshold: float) -> int:
    """So many trees that two vectors at ``threshold`` share no cell of
    ``bits`` hyperplanes with a chance of ``MISS``."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(TREES, math.ceil(math.log(MISS) / math.log1p(-meet)))


def _cells(units: DataFrame, bits: int, trees: range) -> DataFrame:
    """``(tree, dim, code, id, grp, x)``: the sides of ``bits`` hyperplanes on
    which each vector lies in each tree; ``x`` in 32-bit floats."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            frame = batch.to_pandas()
            for dim, part in frame.groupby("dim"):
                x = _stack(part["x"])
                short = [v.tobytes() for v in x.astype(np.float32)]
                for tree in trees:
                    planes = np.random.default_rng([tree, dim]).normal(size=(dim, bits))
                    cell = ((x @ planes) > 0) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(x), tree, np.int32)),
                            pa.array(part["dim"].to_numpy(np.int32)),
                            pa.array(cell),
                            pa.array(part["id"].to_numpy(np.int64)),
                            pa.array(part["grp"].to_numpy(np.int64)),
                            pa.array(short, pa.binary()),
                        ],
                        ["tree", "dim", "code", "id", "grp", "x"],
                    )

    return units.mapInArrow(code, "tree int, dim int, code long, id long, grp long, x binary")


def _nearest_in_cell(frame: pd.DataFrame) -> pd.DataFrame:
    ids, x = frame["id"].to_numpy(), _stack(frame["x"], np.float32)
    k = min(NEIGHBOURS, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"id": [], "nb": [], "sim": []}).astype({"id": "int64", "nb": "int64", "sim": "float32"})
    sims = x @ x.T
    grp = frame["grp"].to_numpy()
    sims[grp[:, None] == grp[None, :]] = -2
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    found = np.take_along_axis(sims, best, axis=1)
    out = pd.DataFrame(
        {"id": np.repeat(ids, k), "nb": ids[best].ravel(), "sim": found.ravel().astype(np.float32)}
    )
    return out[out["sim"] > -2]


def _best(edges: DataFrame) -> DataFrame:
    """``(id, nb, sim)``: each id's ``NEIGHBOURS`` best; ``fresh``, if given, is
    0 for an entry that also came with 0."""
    fresh = [F.min("fresh").alias("fresh")] if "fresh" in edges.columns else []
    edges = edges.groupBy("id", "nb").agg(F.max("sim").alias("sim"), *fresh)
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "nb")
    ranked = edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS)
    return ranked.drop("rank")


def _dealt(cells: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """``cells`` with ``depth`` and ``cell``: crowded cells are split by
    ``STEP`` more hyperplanes, ``SPLITS`` times at most; and the most
    hyperplanes used."""
    spark = cells.sparkSession
    rows = cells.withColumn("depth", F.lit(bits))
    for split in range(SPLITS + 1):
        deepest = bits + split * STEP
        rows = rows.withColumn("cell", F.col("code").bitwiseAND(F.expr("shiftleft(1L, depth) - 1")))
        if split == SPLITS:
            break
        crowded = rows.groupBy("tree", "dim", "depth", "cell").agg(F.count(F.lit(1)).alias("n"))
        crowded = crowded.where((F.col("n") > 4 * CELL) & (F.col("depth") == deepest))
        crowded = materialise(spark, crowded.drop("n").withColumn("more", F.lit(STEP)), "nn-crowded")
        if crowded.isEmpty():
            break
        rows = rows.join(crowded, ["tree", "dim", "depth", "cell"], "left")
        rows = rows.withColumn("depth", F.col("depth") + F.coalesce("more", F.lit(0))).drop("more")
    return rows, deepest


def _start(units: DataFrame, n: int, first: int, threshold: float) -> DataFrame:
    """Lists from cells of trees ``first`` and on, as many as the deepest cells
    need."""
    spark = units.sparkSession
    bits = max(1, math.ceil(math.log2(max(2, n / CELL))))
    graph, done, needed = None, 0, _trees_for(bits, threshold)
    while done < needed:
        count = math.ceil((needed - done) / math.ceil((needed - done) / TREES_AT_ONCE))
        trees = range(first + done, first + done + count)
        cells = materialise(spark, _cells(units, bits + SPLITS * STEP, trees), "nn-cells")
        rows, deepest = _dealt(cells, bits)
        needed = max(needed, _trees_for(deepest, threshold))
        # What is still crowded, close copies, is dealt by hash.
        full = rows.groupBy("tree", "dim", "depth", "cell").agg(F.count(F.lit(1)).alias("n"))
        full = materialise(spark, full.where(F.col("n") > 4 * CELL), "nn-crowded")
        dealt = rows.join(full, ["tree", "dim", "depth", "cell"], "left")
        parts = F.ceil(F.col("n") / CELL)
        part = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "tree"), parts))
        dealt = dealt.select("tree", "dim", "depth", "cell", part.cast("long").alias("part"), "id", "grp", "x")
        edges = dealt.groupBy("tree", "dim", "depth", "cell", "part").applyInPandas(
            lambda frame: _nearest_in_cell(frame), "id long, nb long, sim float"
        )
        graph = materialise(spark, _best(edges if graph is None else edges.unionByName(graph)), "nn-graph")
        done += count
    return graph


def _descend(units: DataFrame, graph: DataFrame, turn: int, near: DataFrame | None = None) -> DataFrame:
    """Edges found by comparing the neighbours of each vector, those in the
    lists ``near`` as well; both ends are of different ``grp``."""
    spark = units.sparkSession
    worst = graph.groupBy("id").agg(
        F.when(F.count(F.lit(1)) < NEIGHBOURS, F.lit(-2.0)).otherwise(F.min("sim")).cast("float").alias("worst")
    )
    short = units.join(worst, "id", "left").select(
        "id", "grp", "dim", "x", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst")
    )
    short = materialise(spark, short, "nn-units")
    if near is not None:
        graph = graph.unionByName(near)
    back = graph.select(F.col("nb").alias("at"), F.col("id").alias("member"))
    order = Window.partitionBy("at").orderBy(F.xxhash64(F.lit(turn), "member"))
    back = back.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS)
    ahead = graph.select(F.col("id").alias("at"), F.col("nb").alias("member"))
    around = ahead.unionByName(back.drop("rank")).distinct()
    around = materialise(spark, around, "nn-around")
    members = around.join(short.withColumnRenamed("id", "member"), "member")
    lists = members.groupBy("at").agg(F.collect_list(F.struct("member", "grp", "worst", "x")).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_all, b_all, s_all = [], [], []
            for row in batch.column(1):
                inner = row.values
                ids = inner.field("member").to_numpy()
                grp = inner.field("grp").to_numpy()
                worst = inner.field("worst").to_numpy()
                xs = inner.field("x").to_pylist()
                if len({len(x) for x in xs}) > 1:
                    continue
                x = _stack(xs).astype(np.float32)
                sims = x @ x.T
                better = (sims > worst[:, None]) & (grp[:, None] != grp[None, :])
                i, j = np.nonzero(better)
                a_all.append(ids[i])
                b_all.append(ids[j])
                s_all.append(sims[i, j])
            if a_all:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(a_all), pa.int64()),
                        pa.array(np.concatenate(b_all), pa.int64()),
                        pa.array(np.concatenate(s_all), pa.float32()),
                    ],
                    ["id", "nb", "sim"],
                )

    return lists.select("at", "m").mapInArrow(compare, "id long, nb long, sim float")


def _verified(units: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Entries of the lists that reach ``threshold`` in double precision."""
    spark = units.sparkSession
    near = graph.where(F.col("sim") >= threshold - SLACK)
    near = near.select(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b")).distinct()
    near = materialise(spark, near, "nn-near")
    x = units.select(F.col("id").alias("a"), F.col("x").alias("xa"))
    y = units.select(F.col("id").alias("b"), F.col("x").alias("xb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                float(np.frombuffer(p, np.float64) @ np.frombuffer(q, np.float64)) >= threshold
                for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    both = near.join(x, "a").join(y, "b").select("a", "b", "xa", "xb")
    return both.mapInArrow(check, "a long, b long")


def _count_links(units: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """``(id, n_links)`` for the members of components: the rows of all other
    vectors that each links with."""
    spark = units.sparkSession
    members = components.join(units.withColumnRenamed("id", "node"), "node")
    members = members.select(F.col("node").alias("id"), "component", "w", "x")
    members = materialise(spark, members, "nn-members")
    firsts = members.where("id = component").select("component", F.col("x").alias("first"))
    firsts = materialise(spark, firsts.dropDuplicates(["component"]), "nn-firsts")
    half = math.acos(threshold) / 2 - 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = [
                bool(math.acos(min(1.0, max(-1.0, float(np.frombuffer(p, np.float64) @ np.frombuffer(q, np.float64))))) <= half)
                for p, q in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(core, pa.bool_())], ["component", "id", "w", "x", "core"]
            )

    placed = members.join(firsts, "component").select("component", "id", "w", "x", "first")
    placed = placed.mapInArrow(place, "component long, id long, w long, x binary, core boolean")
    placed = materialise(spark, placed, "nn-placed")
    sizes = placed.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("core"), 1)).alias("n_core"),
        F.sum(F.when(F.col("core"), F.col("w"))).alias("w_core"),
    )
    sizes = materialise(spark, sizes, "nn-sizes")
    rows = placed.join(sizes, "component")
    outer = F.ceil((F.col("n") - F.col("n_core")) / TILE).cast("int")  # tiles of members out of the core
    every = F.ceil(F.col("n") / TILE).cast("int")  # tiles of all members
    own_outer = F.pmod(F.xxhash64(F.lit(1), "id"), F.greatest(outer, F.lit(1))).cast("int")
    own_every = F.pmod(F.xxhash64(F.lit(2), "id"), every).cast("int")
    open_rows = rows.where("n > n_core")
    left = open_rows.where("not core").select(
        "component", own_outer.alias("i"), F.explode(F.sequence(F.lit(0), every - 1)).alias("j"),
        "id", "w", "x", "core", F.lit(True).alias("outer"),
    )
    right = open_rows.select(
        "component", F.explode(F.sequence(F.lit(0), outer - 1)).alias("i"), own_every.alias("j"),
        "id", "w", "x", "core", F.lit(False).alias("outer"),
    )

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["outer"]], frame[~frame["outer"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        linked = (_stack(a["x"]) @ _stack(b["x"]).T) >= threshold
        linked &= a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
        core, weights = b["core"].to_numpy(), b["w"].to_numpy()
        return pd.DataFrame(
            {
                "id": np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()[core]]),
                "links": np.concatenate([linked @ weights, a["w"].to_numpy() @ linked[:, core]]).astype(np.int64),
            }
        )

    tiles = left.unionByName(right).groupBy("component", "i", "j")
    counted = tiles.applyInPandas(tile, "id long, links long")
    counted = counted.groupBy("id").agg(F.sum("links").alias("links"))
    counted = materialise(spark, counted, "nn-counted")
    among = F.when(F.col("core"), F.col("w_core") - F.col("w")).otherwise(F.lit(0))
    return rows.join(counted, "id", "left").select(
        "id", (among + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")
    )


def _true_links(nodes: DataFrame, picked: list, threshold: float) -> dict[int, int]:
    """The rows of other vectors that each of ``picked`` links with, compared
    with all rows."""
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in picked}:
        own = [r for r in picked if r.dim == dim]
        queries[dim] = (np.array([r.id for r in own]), _stack([r.x for r in own]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dim: np.zeros(len(ids), np.int64) for dim, (ids, _) in queries.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                frame = batch.slice(at, 2048).to_pandas()
                for dim, part in frame.groupby("dim"):
                    if dim in queries:
                        ids, x = queries[dim]
                        linked = (x @ _stack(part["x"]).T) >= threshold
                        linked &= ids[:, None] != part["id"].to_numpy()[None, :]
                        sums[dim] += linked @ part["w"].to_numpy()
        for dim, links in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries[dim][0], pa.int64()), pa.array(links, pa.int64())], ["id", "links"]
            )

    found = nodes.select("id", "dim", "x", "w").mapInArrow(count, "id long, links long")
    return {r.id: r.t for r in found.groupBy("id").agg(F.sum("links").alias("t")).collect()}


def audit(
    nodes: DataFrame, holders: DataFrame, components: DataFrame, counts: DataFrame, threshold: float
) -> dict[str, tuple[int, int, float]]:
    """For vectors of ``small`` and of ``large`` components: how many with
    links were compared with all rows, how many of them have all their links,
    and the mean share found. A vector whose component is split lacks links.

    The vectors of ids divisible by 20 come first, then the others, block by
    block up to ``BLOCKS``, until ``EVIDENCE`` vectors of small components have
    links. Without an entry for ``small`` there is no evidence, unless all
    vectors were compared (``all``)."""
    spark = nodes.sparkSession
    asked = holders.where("id % 20 = 0").select(F.col("node").alias("id")).distinct()
    asked = materialise(spark, asked.withColumn("asked", F.lit(True)), "nn-asked")
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = components.join(sizes, "component").select(F.col("node").alias("id"), "size")
    rows = nodes.join(asked, "id", "left").join(sizes, "id", "left").join(counts, "id", "left").select(
        "id", "dim", "x", F.coalesce("asked", F.lit(False)).alias("asked"),
        (F.coalesce("size", F.lit(1)) > LARGE).alias("large"), F.coalesce("n_links", F.lit(0)).alias("found"),
    )
    rows = materialise(spark, rows, "nn-audit")
    shares: dict[str, list[float]] = {"small": [], "large": []}
    seen = blocks = 0
    for in_set in (True, False):
        own = rows.where(F.col("asked") == in_set)
        parts = math.ceil(own.count() / BLOCK)
        for part in range(parts):
            if blocks == BLOCKS or len(shares["small"]) >= EVIDENCE:
                break
            picked = own.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(parts)) == part).collect()
            true = _true_links(nodes, picked, threshold) if picked else {}
            for r in picked:
                if true[r.id]:
                    shares["large" if r.large else "small"].append(min(1.0, r.found / true[r.id]))
            seen += len(picked)
            blocks += 1
    result = {k: (len(v), sum(s == 1 for s in v), sum(v) / len(v)) for k, v in shares.items() if v}
    return result | ({"all": (seen, seen, 1.0)} if seen == rows.count() else {})


def _passed(audited: dict[str, tuple[int, int, float]]) -> bool:
    """Whether there is evidence and in each kind of component enough vectors
    have all their links."""
    kinds = [v for k, v in audited.items() if k != "all"]
    evidence = "small" in audited or "all" in audited
    return evidence and all(whole >= MIN_RECALL * n for n, whole, _ in kinds)


def _own_links(holders: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``(id, node, own)``: the id's own rows that the vector links with."""
    spark = holders.sparkSession
    several = holders.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    several = materialise(spark, holders.join(several, "id", "left_semi"), "nn-several")
    others = several.select("id", F.col("node").alias("nb"), F.col("own").alias("more"))
    pairs = several.select("id", "node").join(others, "id").where("node <> nb")
    both = pairs.select(F.col("node").alias("id"), "nb", F.lit(1.0).alias("sim"))
    links = _verified(nodes, both, threshold)
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = links.select(F.col("a").alias("node"), F.col("b").alias("nb"))
    return pairs.join(links, ["node", "nb"]).select("id", "node", F.col("more").alias("own"))


def _graph(
    units: DataFrame, n: int, first: int, threshold: float, edges: DataFrame | None = None, near: DataFrame | None = None
) -> DataFrame:
    """The lists of ``units`` after start and descent, from ``edges`` on. The
    descent ends when few entries change."""
    spark = units.sparkSession
    graph = _start(units, n, first, threshold)
    if edges is not None:
        graph = materialise(spark, _best(graph.unionByName(edges)), "nn-graph")
    for turn in range(ROUNDS):
        more = _descend(units, graph, first + turn, near).withColumn("fresh", F.lit(1))
        both = materialise(spark, _best(graph.withColumn("fresh", F.lit(0)).unionByName(more)), "nn-graph")
        fresh, entries = both.agg(F.sum("fresh"), F.count(F.lit(1))).first()
        graph = both.drop("fresh")
        if not entries or fresh <= CHANGED * entries:
            break
        LOG.info("descent, round %d: %d of %d entries changed", turn + 1, fresh, entries)
    return graph


def _components(nodes: DataFrame, graph: DataFrame, holders: DataFrame, first: int, threshold: float) -> DataFrame:
    """``(node, component)`` over the links in the lists and those that join
    the components of nodes with saturated lists."""
    spark = nodes.sparkSession
    low = threshold - SLACK
    saturated = graph.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst"))
    saturated = saturated.where((F.col("n") >= NEIGHBOURS) & (F.col("worst") >= low)).select("id")
    saturated = materialise(spark, nodes.join(saturated, "id", "left_semi"), "nn-saturated")
    n = saturated.count()
    near = graph.join(saturated.select("id"), "id", "left_semi")
    near = near.join(saturated.select(F.col("id").alias("nb")), "nb", "left_semi").select("id", "nb", "sim")
    near = materialise(spark, near, "nn-near")
    one = holders.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    one = holders.join(one, "id").select("a", F.col("node").alias("b"))  # vectors of one id
    links = materialise(spark, _verified(nodes, graph, threshold).unionByName(one), "nn-links")
    while True:
        components = materialise(spark, connected_components(links), "nn-components")
        named = components.select(F.col("node").alias("id"), F.col("component").alias("grp"))
        units = materialise(spark, saturated.join(named, "id"), "nn-foreign")
        if units.agg(F.count_distinct("grp")).first()[0] < 2:
            return components
        found = _verified(nodes, _graph(units, n, first, threshold, near=near), threshold)
        found = materialise(spark, found, "nn-links")
        if found.isEmpty():
            return components
        links = links.unionByName(found)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
) -> DataFrame:
    """Every row of ``vectors`` as ``(id, n_links, component_id)``."""
    spark = vectors.sparkSession
    rows = materialise(spark, unit_vectors(vectors, id_col, vector_col), "nn-units")
    nodes, holders = _nodes(rows)
    n = nodes.count()
    units = nodes.withColumn("grp", F.col("id"))
    graph = None
    counts = components = None
    for attempt in range(ATTEMPTS):
        graph = _graph(units, n, attempt * 1000, threshold, graph)
        components = _components(nodes, graph, holders, attempt * 1000, threshold)
        counts = materialise(spark, _count_links(nodes, components, threshold), "nn-counts")
        audited = audit(nodes, holders, components, counts, threshold)
        LOG.info("audit of attempt %d (vectors, with all links, mean recall): %s", attempt + 1, audited)
        if _passed(audited):
            break
    else:
        if audited:
            raise RuntimeError(f"recall below {MIN_RECALL} after {ATTEMPTS} attempts: {audited}")
        LOG.warning("no audited vector has a link: recall is not known")
    named = nodes.select(F.col("id").alias("node"), "w", "first").join(components, "node", "left")
    named = named.select("node", "w", "first", F.coalesce("component", "node").alias("component"))
    named = materialise(spark, named, "nn-named")
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = named.join(firsts, "component").join(counts.withColumnRenamed("id", "node"), "node", "left")
    linked = linked.select("node", "component_id", (F.col("w") + F.coalesce("n_links", F.lit(0))).alias("n"))
    own = holders.unionByName(_own_links(holders, nodes, threshold))
    own = own.groupBy("id", "node").agg(F.sum("own").alias("own"))
    found = own.join(linked, "node").groupBy("id").agg(
        F.max(F.col("n") - F.col("own")).alias("n_links"), F.min("component_id").alias("component_id")
    )
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    return ids.join(found, "id", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
