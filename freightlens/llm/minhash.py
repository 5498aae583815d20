"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles; a document's sketch is the ``SKETCH``
least hashes of its shingle set. Documents with equal sets form a class and are
represented by the one with the least id. Then:

1. Inverted lists. The ``INDEXED`` least hashes of each class are counted over
   all classes. A linked pair shares at least ``s`` of them (all but a chance
   of ``MISS``; certain where the sketch is the whole set), so it shares one of
   the ``m - s + 1`` values that are rarest over the corpus, whatever the other
   values are. Only those are listed, which keeps passages that very many
   documents share out of the lists without dropping any candidate.
2. Overlaps. Each list first links its members to one leader; members that the
   verified links already connect need no pair of their own. The documents of
   lists that still hold several components are listed once more, now under the
   rarest values of their whole sets. There the required overlap is exact, not
   estimated, and far fewer values do. Those lists choose leaders again, and
   what is left at last is paired in full across components, under the size
   filter.
3. A candidate whose sketches, merged to the sketch of the union, estimate a
   similarity well below the threshold is dropped; the others are verified on
   their full sets.
4. Connected components over verified links; every document takes the
   component of its class.

Defined results: null, empty and blank texts have an empty set and link with
nothing; rows that share an id are one document, linked by any of its texts;
rows without an id form no links and have no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.components import connected_components
from freightlens.llm.shingles import shingle_sets
from freightlens.plans.session import materialise

SKETCH = 64
INDEXED = 48
MISS = 1e-6  # chance to lose a pair at the threshold, for each filter


def least_overlap(k: int, share: float) -> int:
    """The greatest ``s`` with P(Binomial(k, share) < s) <= ``MISS``."""
    below, s = 0.0, 0
    while s < k:
        below += math.comb(k, s) * share**s * (1 - share) ** (k - s)
        if below > MISS:
            break
        s += 1
    return max(1, s)


def _sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, least = [], [], [], []
            for found in shingle_sets(batch.column(1), n):
                mark = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append(len(found))
                high.append(int.from_bytes(mark[:8], "big", signed=True))
                low.append(int.from_bytes(mark[8:], "big", signed=True))
                least.append(found[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(least, pa.list_(pa.int64())),
                ],
                ["id", "n", "s1", "s2", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, s1 long, s2 long, sketch array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(id, full)``: the shingle sets of the documents in ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(shingle_sets(part.column(1), n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "full"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(sets, "id long, full array<long>")


def _similar_sizes(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


class _Verifier:
    """Confirms candidate pairs: estimate on sketches, then full sets."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, percent: int):
        self.sketches, self.sets, self.percent = sketches, sets, percent

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (``a``, ``b``) those that are linked."""
        spark = pairs.sparkSession
        pairs = materialise(spark, pairs.distinct(), "near-pairs")
        of_a = self.sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
        of_b = self.sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
        both = pairs.join(of_a, "a").join(of_b, "b")
        union = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
        common = F.size(F.array_intersect(F.array_intersect("x", "y"), union))
        floor = least_overlap(SKETCH, self.percent / 100)
        # A union smaller than a sketch is known in full; there the floor
        # scales down with it.
        enough = common * SKETCH >= floor * F.size(union)
        likely = materialise(spark, both.where(enough).select("a", "b"), "likely-pairs")
        of_a = self.sets.select(F.col("id").alias("a"), F.col("full").alias("x"))
        of_b = self.sets.select(F.col("id").alias("b"), F.col("full").alias("y"))
        exact = likely.join(of_a, "a").join(of_b, "b")
        exact = exact.select(
            "a",
            "b",
            F.size("x").alias("nx"),
            F.size("y").alias("ny"),
            F.size(F.array_intersect("x", "y")).alias("common"),
        )
        linked = 100 * F.col("common") >= self.percent * (
            F.col("nx") + F.col("ny") - F.col("common")
        )
        return materialise(spark, exact.where(linked).select("a", "b"), "near-links")


def _listed(postings: DataFrame, needed: Column) -> DataFrame:
    """``(v, id, n, left)`` of ``postings`` (``id, n, m, v``: one of ``m``
    values): each id under the rarest of its values, so many that two ids with
    ``needed`` values in common meet. ``left`` counts the values from this one
    to the commonest: no more can be shared with an id met here first."""
    spark = postings.sparkSession
    df = postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = materialise(spark, df, "shared-values")
    listed = (
        postings.join(shared, "v")
        .groupBy("id", "n", "m")
        .agg(F.sort_array(F.collect_set(F.struct("df", "v"))).alias("by_df"))
    )
    # Values of one id alone are the rarest: they come first and list nothing.
    alone = F.col("m") - F.size("by_df")
    take = F.greatest(F.lit(0), F.col("m") - needed + 1 - alone).cast("int")
    listed = listed.select(
        "id",
        "n",
        F.size("by_df").alias("shared"),
        F.posexplode(F.slice("by_df", F.lit(1), take)).alias("at", "x"),
    )
    return listed.select(
        F.col("x.v").alias("v"), "id", "n", (F.col("shared") - F.col("at")).alias("left")
    )


def _lists_of_sketches(classes: DataFrame, percent: int) -> DataFrame:
    indexed = F.slice("sketch", 1, INDEXED)
    postings = classes.select("id", "n", F.size(indexed).alias("m"), F.explode(indexed).alias("v"))
    needed = F.least(
        F.lit(least_overlap(INDEXED, percent / 100)), F.ceil(F.col("m") * percent / 100)
    )
    return _listed(postings, needed)


def _lists_of_sets(sets: DataFrame, percent: int) -> DataFrame:
    size = F.size("full")
    postings = sets.select("id", size.alias("n"), size.alias("m"), F.explode("full").alias("v"))
    return _listed(postings, F.ceil(F.col("m") * percent / 100))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Every row of ``docs`` as ``(id, n_shingles, component_id)``; documents
    are linked at a Jaccard similarity of at least ``percent`` hundredths of
    their sets of ``n``-word shingles, and ``component_id`` is the least id
    reachable over links."""
    spark = docs.sparkSession
    sketched = materialise(spark, _sketches(docs, id_col, text_col, n), "sketches")
    usable = sketched.where("n > 0 and id is not null")
    same = usable.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    same = materialise(spark, same, "equal-sets")
    members = usable.select("id", "n", "s1", "s2").join(same, ["s1", "s2", "n"])
    members = materialise(spark, members.select("id", "n", "rep"), "class-members")
    marked = same.withColumnRenamed("rep", "id")
    classes = usable.join(marked, ["id", "s1", "s2", "n"], "left_semi")

    lists = materialise(spark, _lists_of_sketches(classes, percent), "inverted-lists")
    listed = lists.select("id").distinct()
    sketches = materialise(
        spark, classes.join(listed, "id", "left_semi").select("id", "sketch"), "listed-sketches"
    )
    sets = materialise(spark, _full_sets(docs, listed, id_col, text_col, n), "listed-sets")
    verify = _Verifier(sketches, sets, percent)

    # Rows that share an id tie the classes of their texts together.
    own = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    tied = members.join(own.where("a < z").select("id", "a"), "id").where("a <> rep")
    links = materialise(spark, tied.select("a", F.col("rep").alias("b")), "tied-classes")
    found = verify(_leader_pairs(_open_lists(lists, None), percent))
    links = links.unionByName(found)
    labels = materialise(spark, connected_components(links), "near-components")
    unsettled = _open_lists(lists, labels).select("id").distinct()
    unsettled = materialise(spark, unsettled, "unsettled")
    lists = _lists_of_sets(sets.join(unsettled, "id", "left_semi"), percent)
    lists = materialise(spark, lists, "inverted-lists")
    found = verify(_pairs_across(_open_lists(lists, labels), percent))
    links = links.unionByName(found)
    labels = materialise(spark, connected_components(links), "near-components")
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    rest = sketched.where("n = 0 or id is null").select(
        "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")
    )
    return named.unionByName(rest)


def _open_lists(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """List rows ``(v, id, n, left, c)`` of the lists that hold more than one
    component."""
    spark = lists.sparkSession
    if labels is None:
        rows = lists.withColumn("c", F.col("id"))
    else:
        rows = lists.join(labels.withColumnRenamed("node", "id"), "id", "left")
        rows = rows.select("v", "id", "n", "left", F.coalesce("component", "id").alias("c"))
    rows = materialise(spark, rows, "list-rows")
    several = rows.groupBy("v").agg(F.min("c").alias("x"), F.max("c").alias("y"))
    several = materialise(spark, several.where("x < y").select("v"), "open-lists")
    return rows.join(several, "v")


def _leader_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each row with one leader of its list, if that is in another component."""
    rows = materialise(rows.sparkSession, rows, "open-rows")
    leaders = rows.groupBy("v").agg(F.min(F.struct("id", "n", "c")).alias("x"))
    leaders = leaders.select(
        "v", F.col("x.id").alias("lead"), F.col("x.n").alias("lead_n"), F.col("x.c").alias("lead_c")
    )
    leaders = materialise(rows.sparkSession, leaders, "list-leaders")
    met = rows.join(leaders, "v").where(F.col("c") != F.col("lead_c"))
    met = met.where(_similar_sizes(F.col("n"), F.col("lead_n"), percent))
    return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))


def _pairs_across(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list across components that can still be linked: with
    sizes n and m in common, a link needs p/(100+p) of n + m in common."""
    rows = materialise(rows.sparkSession, rows, "open-rows")
    x = rows.where((100 + percent) * F.col("left") >= 2 * percent * F.col("n"))
    x = x.select("v", "id", "n", "c", "left")
    y = rows.select(
        "v",
        F.col("id").alias("other"),
        F.col("n").alias("other_n"),
        F.col("c").alias("other_c"),
        F.col("left").alias("other_left"),
    )
    met = x.join(y, "v").where("c <> other_c and (n < other_n or n = other_n and id <> other)")
    met = met.where(
        (100 + percent) * F.least("left", "other_left")
        >= percent * (F.col("n") + F.col("other_n"))
    )
    met = met.where(100 * F.col("n") >= percent * F.col("other_n"))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that with the least id;
    documents without an id or a shingle stay."""
    spark = docs.sparkSession
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.where("component_id <> id").select(F.col("id").alias("__gone")).distinct()
    gone = materialise(spark, gone, "near-gone")
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
