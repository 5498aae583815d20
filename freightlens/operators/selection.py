"""Exact order statistics by radix selection.

To find the value of a rank nothing is sorted and no value is shuffled. A pass
counts the values by the leading digit of their distance from the least one,
``buckets`` counters for each range in question, combined map-side; the
counters, with the least and the greatest value of each, tell which digit holds
the rank, and the next pass looks at that range alone. It ends when a range
holds one value. All ranks wanted are followed in the same passes, each a scan
of one column with the ranges as pushed-down filters. A whole number or a decimal
of 18 digits needs at most six passes with 4,096 counters, mostly two or three
(ranges shrink to the values they hold); the driver sees the counters only.

Whole numbers and decimals are counted by their exact units. Doubles are
counted by sign and binary exponent in the first pass and by equal steps of the
range after it; any division that keeps the order will do, since the ranges are
cut by the values themselves. NaN is greater than all others, as Spark orders
it, and -0.0 equals 0.0.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _units(df: DataFrame, value_col: str) -> tuple[Column, int | None]:
    """The values in the form they are counted in, and the fraction digits of
    whole units; None for doubles."""
    v, kind = F.col(value_col), df.schema[value_col].dataType
    if isinstance(kind, _WHOLE):
        return v.cast("decimal(20,0)"), 0
    if isinstance(kind, T.DecimalType):
        return v, kind.scale
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return v.cast("double") + F.lit(0.0), None
    raise TypeError(f"no order statistics of {kind.simpleString()}")


def _digit(v: Column, low, high, scale: int | None, buckets: int, first: bool) -> Column:
    """The digit, from 0, of a value of the range ``low`` to ``high``: a
    function that never falls as the value grows."""
    if scale is not None:
        step = -(-(int((high - low).scaleb(scale)) + 1) // buckets)
        steps = (v - F.lit(low)).cast(f"decimal(38,{scale})")
        return F.call_function("div", steps, F.lit(Decimal(step).scaleb(-scale))).cast("int")
    if first:  # by sign and exponent; infinities and NaN stand apart
        size = F.floor(F.least(F.log2(F.greatest(F.abs(v), F.lit(5e-324))), F.lit(1100.0)))
        digit = F.when(v == 0, 0).otherwise(F.signum(v) * (size + 1100))
        return F.when(F.isnan(v), 5000).otherwise(digit).cast("int")
    # One sign and exponent: the width is a finite double.
    return F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(buckets))).cast("int")


def values_at(df: DataFrame, value_col: str, positions, buckets: int = BUCKETS) -> tuple[dict, int]:
    """``({rank: value}, n)``: the values of the ranks that ``positions(n)``
    asks for, counted from 0 over the ``n`` values that are not NULL."""
    v, scale = _units(df, value_col)
    rows = df.where(F.col(value_col).isNotNull()).select(v.alias("_v"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    found: dict[int, object] = {}
    if not n:
        return found, 0
    # (least, greatest, rank of the least): ranges that hold ranks in question
    ranges = {(low, high, 0): sorted(set(positions(n)))}
    first = True
    while ranges:
        for low, high, below in [r for r in ranges if _equal(r[0], r[1])]:
            found.update(dict.fromkeys(ranges.pop((low, high, below)), low))
        if not ranges:
            break
        held = list(ranges)
        which, digit, inside = None, None, None
        for k, (low, high, _) in enumerate(held):
            own = F.col("_v").between(F.lit(low), F.lit(high))
            its = _digit(F.col("_v"), low, high, scale, buckets, first)
            which = F.when(own, k) if which is None else which.when(own, k)
            digit = F.when(own, its) if digit is None else digit.when(own, its)
            inside = own if inside is None else inside | own
        counted = (
            rows.where(inside)
            .groupBy(which.alias("range"), digit.alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
            .collect()  # `buckets` rows a range at most
        )
        narrowed: dict[tuple, list[int]] = {}
        for k, key in enumerate(held):
            at, below = ranges[key], key[2]
            for row in sorted((r for r in counted if r["range"] == k), key=lambda r: r["digit"]):
                mine = [r for r in at if below <= r < below + row["n"]]
                if mine:
                    narrowed[row["low"], row["high"], below] = mine
                below += row["n"]
        if set(narrowed) == set(ranges) and not first:
            raise ArithmeticError(f"{value_col}: ranges do not narrow: {list(narrowed)}")
        ranges, first = narrowed, False
    return found, n


def _equal(a, b) -> bool:
    return a == b or (a != a and b != b)


def exact_quantiles(
    df: DataFrame, value_col: str, probs: dict[str, float], buckets: int = BUCKETS
) -> DataFrame:
    """One row: the continuous quantile (linear interpolation between the two
    closest ranks, position ``p * (n - 1)``) for each ``{name: p}``, as doubles;
    NULL without values. The passes run when this is called."""

    def asked(n: int) -> list[int]:
        low = [math.floor((n - 1) * float(p)) for p in probs.values()]
        return [*low, *(min(k + 1, n - 1) for k in low)]

    values, n = values_at(df, value_col, asked, buckets)
    row = []
    for p in probs.values():
        if not n:
            row.append(None)
            continue
        position = float(n - 1) * float(p)
        k = math.floor(position)
        low, high = float(values[k]), float(values[min(k + 1, n - 1)])
        row.append(low if low == high else low + (position - k) * (high - low))
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in probs])
    return df.sparkSession.createDataFrame([tuple(row)], schema)
