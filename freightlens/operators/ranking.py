"""Exact rank positions without a single-partition window.

``Window.orderBy(x)`` with no partition puts every row into one task. That is
fine for a few hundred groups, but not for a relation that grows with the data
(one row per product, say). ``ranks_below`` gives each row, for any number of
measures at once, the number of rows with a strictly smaller value. From that,
``percent_rank`` and quantile buckets follow exactly.

The measures are taken in long form, ``(measure, value)``, so that one plan
serves them all:

1. ``groupBy(measure, value).count()``. One row per distinct value, combined
   map-side, so a value that holds a third of all rows is one row here.
2. ``percentile_approx`` per measure gives the split points of ``buckets``
   ranges (a bounded sketch, one row per measure, used as a scalar subquery). A
   value finds its range by two searches over a square root of the splits each.
   Equal values always share a range, and ranges hold about the same number of
   distinct values.
3. One window pass partitioned by measure and range gives, per distinct value,
   the exclusive running count inside its range and the range's total.
4. The totals are one row per range (``buckets`` rows a measure). An exclusive
   running sum over them gives each range's offset.
5. ``n_below = offset + running count``. It meets the rows by measure and
   value; a hot value is one row on the rank side, and AQE's skew-join handling
   splits the big side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, buckets: int | None) -> int:
    return buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_of(value: Column, splits: Column, n: int) -> Column:
    """The number of the ``n`` ascending ``splits`` strictly below ``value``:
    first by every so-many-th split, then among those between."""
    step = max(1, math.isqrt(n))
    heads = F.filter(splits, lambda s, i: i % step == 0)
    head = F.size(F.filter(heads, lambda s: s < value))
    start = F.greatest(head - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(splits, start + 1, F.lit(step)), lambda s: s < value))


def _ranked_values(counts: DataFrame, buckets: int, accuracy: int) -> DataFrame:
    """``counts`` (``_m, _v, _cnt``, one row per distinct value of a measure)
    with ``n_below``, the rows of the measure with a smaller value."""
    probs = [i / buckets for i in range(1, buckets)]
    # One row (a global aggregate over one row per measure), as a scalar subquery.
    splits = counts.groupBy("_m").agg(F.percentile_approx("_v", probs, accuracy).alias("s"))
    splits = splits.agg(F.map_from_entries(F.collect_list(F.struct("_m", "s"))).alias("s")).scalar()
    ranged = counts.withColumn("_splits", splits).withColumn("_splits", F.element_at("_splits", F.col("_m")))
    ranged = ranged.withColumn("_b", _range_of(F.col("_v"), F.col("_splits"), len(probs))).drop("_splits")
    before = Window.unboundedPreceding
    own = Window.partitionBy("_m", "_b")
    # One exchange serves both windows.
    within = ranged.withColumns(
        {
            "_within": F.coalesce(F.sum("_cnt").over(own.orderBy("_v").rowsBetween(before, -1)), F.lit(0)),
            "_total": F.sum("_cnt").over(own),
        }
    )
    # Already partitioned by measure and range, so the group-by adds no exchange.
    totals = within.groupBy("_m", "_b").agg(F.max("_total").alias("_total"))
    lower = Window.partitionBy("_m").orderBy("_b").rowsBetween(before, -1)
    offsets = totals.select("_m", "_b", F.coalesce(F.sum("_total").over(lower), F.lit(0)).alias("_off"))
    return within.join(F.broadcast(offsets), ["_m", "_b"]).select(
        "_m", "_v", "_cnt", (F.col("_off") + F.col("_within")).cast("bigint").alias("n_below")
    )


def ranks_below(
    df: DataFrame,
    measures: Mapping[str, Column],
    buckets: int | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """``df`` with a column per measure, ``{name: value}``: how many rows have a
    strictly smaller value, NULL for NULL. The measures need one common type.

    All measures go through one plan. Equal rows of ``df`` are taken as one row
    with a number, so rows are told apart by their own columns.
    """
    names = list(measures)
    rows = df.withColumns({f"_v{i}": measures[name] for i, name in enumerate(names)})
    rows = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count(F.lit(1)).alias("_same"))
    entries = [F.struct(F.lit(i).alias("_m"), F.col(f"_v{i}").alias("_v")) for i in range(len(names))]
    long = rows.select("*", F.explode(F.array(*entries)).alias("_e"))
    long = long.select(*[f"`{c}`" for c in rows.columns], "_e._m", "_e._v")
    counts = long.where(F.col("_v").isNotNull()).groupBy("_m", "_v").agg(F.sum("_same").alias("_cnt"))
    ranks = _ranked_values(counts, _buckets(df, buckets), accuracy).select("_m", "_v", "n_below")
    told = long.join(ranks, ["_m", "_v"], "left")
    wide = told.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(
        *[F.max(F.when(F.col("_m") == i, F.col("n_below"))).alias(name) for i, name in enumerate(names)]
    )
    again = F.explode(F.sequence(F.lit(1), F.col("_same").cast("int")))
    return wide.select(*[f"`{c}`" for c in df.columns], *names, again.alias("_n")).drop("_n")


def rank_below(
    df: DataFrame,
    value_col: str,
    buckets: int | None = None,
    accuracy: int = 10_000,
    out_col: str = "n_below",
    total_col: str = "n_valid",
) -> DataFrame:
    """Add ``n_below`` (rows whose value is strictly smaller) and ``n_valid``
    (rows with a non-NULL value). Both are NULL for a NULL value."""
    v = F.col(f"`{value_col}`")
    counts = df.where(v.isNotNull()).groupBy(F.lit(0).alias("_m"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_cnt"))
    valid = counts.agg(F.sum("_cnt")).scalar()
    ranks = _ranked_values(counts, _buckets(df, buckets), accuracy)
    ranks = ranks.select("_v", F.col("n_below").alias(out_col))
    # A NULL value finds no rank; the rows of the left side all stay.
    told = df.join(ranks, v == F.col("_v"), "left").drop("_v")
    return told.withColumn(total_col, F.when(v.isNotNull(), valid).cast("bigint"))


def quantile_bucket(n_below: Column, n_valid: Column, labels: list[str]) -> Column:
    """Label of the continuous-quantile bin a value falls in.

    For ``q = len(labels)`` bins with edges at the interpolated quantiles
    ``k/q`` (positions ``k*(n-1)/q``), a value is at or below edge ``k``
    exactly when fewer than ``floor(k*(n-1)/q) + 1`` values are smaller than
    it. So the bin follows from ``n_below`` and ``n`` in integer arithmetic.
    Bins are closed on the right, and repeated edges put a value in the lower
    bin.
    """
    q = len(labels)
    n1 = n_valid - F.lit(1)
    expr = None
    for k in range(1, q):
        edge_pos = F.floor((n1 * F.lit(k)) / F.lit(q))
        cond = n_below <= edge_pos
        expr = F.when(cond, F.lit(labels[k - 1])) if expr is None else expr.when(cond, F.lit(labels[k - 1]))
    return F.when(n_below.isNull(), F.lit(None).cast("string")).otherwise(
        expr.otherwise(F.lit(labels[-1]))
    )
