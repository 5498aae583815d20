"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the words to take and is clamped at
``max_epochs`` times its own size; what it cannot take is shared among the
others by weight, until none is above its cap. A target of 1.4 epochs is taken
as one whole repetition of every document and a seeded sample of 0.4: the
documents with the least seeded hashes, up to the place at which their words
come nearest to what is still missing. That place is found by bucket sums and a
window over one bucket of each source, so no source is ever sorted whole.

The hash is that of the whole row, so only equal rows share one, and they are
summed before the window. If the sample ends among equal rows, as many of them
are taken as are needed: they are counted, and one stands for all of them.

Defined results: null texts have size 0; null is a source of its own; rows that
share an id but differ are taken apart; of equal rows (columns with maps left
aside) any may be the ones taken once more; an empty source has target 0; with
nothing to take the result is empty or all zero.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.textops import n_words, null_safe_key
from freightlens.plans.session import materialise

DOCS_PER_BUCKET = 4096
PART = 100_000


def ranked_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` (one row each, column ``source``) with a ``weight`` dealt
    from ``weights`` in turn, by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.get(dealt, place % len(weights)))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (``source``, ``size``, ``weight``) with ``target``. Only the
    sums over clamped and free sources reach the driver, once per round."""
    cap = F.col("size") * float(max_epochs)
    clamped: int | None = None
    level = 0.0
    free = sources.agg(F.sum("weight")).first()[0] or 0.0
    left = budget
    while free > 0:
        level = left / free
        full = cap <= level * F.col("weight")
        n, taken, free = sources.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        left = budget - taken
        if n == clamped:
            break
        clamped = n
    full = (cap <= level * F.col("weight")) if free > 0 else F.lit(True)
    return sources.withColumn(
        "target", F.when(full, cap).otherwise(F.lit(level) * F.col("weight")).cast("double")
    )


def seeded_hash(docs: DataFrame, seed: int) -> Column:
    """Of the whole row; columns that hold maps have no hash and are left aside."""
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in sorted(hashed)])


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """``(sized, plan)``: every document as ``(id, key, size, h)``, and one row
    per source: ``key, source, size, weight, target, whole``, the bucket and hash up
    to which one more repetition is taken, and how many of the ``last_rows`` rows
    of that hash take it."""
    spark = docs.sparkSession
    sized = materialise(
        spark,
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            null_safe_key(F.col(source_col)).alias("key"),
            n_words(F.col(text_col)).alias("size"),
            seeded_hash(docs, seed).alias("h"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("key", "source").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_docs")
    )
    sources = materialise(spark, ranked_weights(sources, weights), "mix-sources")
    total, most = sources.agg(F.sum("size"), F.max("n_docs")).first()
    targets = water_fill(sources, share * (total or 0), max_epochs)
    epochs = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(epochs).cast("long"))
    targets = targets.withColumn("missing", F.col("target") - F.col("whole") * F.col("size"))

    # Which bucket of hashes holds the place at which the sample ends.
    bits = max(1, math.ceil(math.log2(max(1, (most or 0) / DOCS_PER_BUCKET))))
    bucket = F.shiftright(F.col("h"), 64 - bits)
    # Equal rows share a hash: one row from here on, combined map-side.
    hashes = sized.groupBy("key", "h").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    hashes = materialise(spark, hashes.withColumn("bucket", bucket), "mix-hashes")
    sums = hashes.groupBy("key", "bucket").agg(F.sum("words").alias("words"))
    along = Window.partitionBy("key").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(along))
    ends = (
        sums.join(targets.where("missing > 0").select("key", "missing"), "key")
        .where("upto >= missing")
        .groupBy("key", "missing")
        .agg(F.min(F.struct("bucket", "words", "upto")).alias("b"))
        .select("key", "missing", "b.bucket", (F.col("b.upto") - F.col("b.words")).alias("before"))
    )
    inside = hashes.join(ends, ["key", "bucket"])
    by_hash = Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("words").over(by_hash), F.lit(0))
    inside = inside.withColumn("short", F.col("missing") - start)
    each = F.col("words") / F.col("n")
    fit = F.round(F.col("short") / F.nullif(each, F.lit(0.0))).cast("long")
    taken = F.least(F.greatest(F.coalesce(fit, F.col("n")), F.lit(0)), F.col("n"))
    inside = inside.withColumn("taken", taken)
    off = F.abs(F.col("short") - F.col("taken") * each)
    best = F.min(F.struct(off.alias("off"), "h", "taken", "n")).alias("best")
    last = inside.groupBy("key", "bucket").agg(best)
    last = last.select(
        "key",
        "bucket",
        F.col("best.h").alias("last_h"),
        F.col("best.taken").alias("last_taken"),
        F.col("best.n").alias("last_rows"),
    )
    plan = materialise(spark, targets.join(last, "key", "left"), "mix-plan")
    return sized, plan.withColumn("bits", F.lit(bits))


def copies(h: Column) -> Column:
    """Repetitions of a row whose seeded hash is ``h``, from a plan row."""
    place = F.call_function("shiftright", h, F.lit(64) - F.col("bits"))
    last = (h == F.col("last_h")) & (F.col("last_taken") == F.col("last_rows"))
    more = (place < F.col("bucket")) | ((place == F.col("bucket")) & ((h < F.col("last_h")) | last))
    return F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)


def split_group(h: Column) -> Column:
    """Whether the row is one of several equal ones among which the sample ends."""
    part = (F.col("last_taken") > 0) & (F.col("last_taken") < F.col("last_rows"))
    return F.coalesce((h == F.col("last_h")) & part, F.lit(False))


def ends_among_equal(plan: DataFrame) -> bool:
    return not plan.where(split_group(F.col("last_h"))).isEmpty()


def times(rows: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times, with its turn ``at`` from 1. A row is dealt to tasks
    in parts of ``PART`` turns, as one row may stand for very many."""
    n = n.cast("long")
    parts = F.call_function("div", n + (PART - 1), F.lit(PART).cast("long"))
    dealt = rows.withColumns({"_n": n, "_parts": parts}).where("_n > 0")
    dealt = dealt.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    dealt = dealt.repartition("_p")
    first = F.col("_p") * PART + 1
    turns = F.sequence(first, F.least(first + (PART - 1), F.col("_n")))
    return dealt.withColumn("at", F.explode(turns)).drop("_n", "_parts", "_p")


def one_for_all(rows: DataFrame) -> DataFrame:
    """One row of each ``(key, h)`` and their number ``n``. Each task keeps one
    row a hash, at most one hash a source; no row is shuffled or sorted."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple, pa.RecordBatch] = {}
        counts: Counter = Counter()
        for batch in batches:
            pairs = zip(batch.column("key").to_pylist(), batch.column("h").to_pylist())
            for i, pair in enumerate(pairs):
                if pair not in first:
                    first[pair] = batch.take(pa.array([i]))
                counts[pair] += 1
        for pair, row in first.items():
            yield row.set_column(row.schema.get_field_index("n"), "n", pa.array([counts[pair]], pa.int64()))

    found = rows.withColumn("n", F.lit(0).cast("long"))
    found = found.mapInArrow(kept, found.schema)
    others = [F.any_value(c).alias(c) for c in rows.columns if c not in ("key", "h")]
    return found.groupBy("key", "h").agg(*others, F.sum("n").alias("n"))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Every document as ``(id, size, source_size, target, n_copies)``."""
    sized, plan = plan_mix(docs, **options)
    plan = plan.withColumnRenamed("size", "source_size").drop("source")
    joined = sized.join(plan, "key")
    columns = ["id", "size", "source_size", "target"]
    alike = split_group(F.col("h"))
    plain = joined.where(~alike).select(*columns, copies(F.col("h")).alias("n_copies"))
    if not ends_among_equal(plan):
        return plain
    equal = joined.where(alike).groupBy("key", "id", *columns[1:], "whole", "last_taken")
    equal = times(equal.agg(F.count(F.lit(1)).alias("n")), F.col("n"))
    more = F.when(F.col("at") <= F.col("last_taken"), 1).otherwise(0)
    return plain.unionByName(equal.select(*columns, (F.col("whole") + more).alias("n_copies")))


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    source_col = options.get("source_col", "source")
    _, plan = plan_mix(docs, seed=seed, **options)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        null_safe_key(F.col(source_col)).alias("key"),
        seeded_hash(docs, seed).alias("h"),
    )
    joined = packed.join(plan.drop("source", "size"), "key")
    alike = split_group(F.col("h"))
    taken = joined.where(~alike).withColumn("n", copies(F.col("h"))).where("n > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    mixed = repeated.select("row.*")
    if not ends_among_equal(plan):
        return mixed
    equal = one_for_all(joined.where(alike).select("key", "h", "row", "whole", "last_taken"))
    equal = times(equal, F.col("n") * F.col("whole") + F.col("last_taken"))
    return mixed.unionByName(equal.select("row.*"))
