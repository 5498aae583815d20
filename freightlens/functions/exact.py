"""Sums, means and deviations that do not depend on the order of the rows.

Integers and decimals add up exactly, so their aggregates are plain ones. The
sum of doubles depends on the order of the additions, which a shuffle does not
fix. ``grouped`` adds them exactly instead, with built-in functions only:

1. A double falls in a bin of 32 binary orders of magnitude. Scaled by the bin's
   power of two it is a whole number below 2^86, cut into two limbs of 43 bits.
2. ``groupBy(keys, measure, bin)`` sums the limbs as decimals: exact, combined
   map-side, at most 67 rows a key and measure in each task however hot the key.
   All double measures go through one such aggregate.
3. The few bins of a key meet in one row. Carries run from the lowest bin to the
   highest, and the digits are added from the highest down, so numbers that
   cancel (1e300 + 1 - 1e300) do so exactly and the sum is within one unit of
   the last place.

A deviation takes a second pass: squared distances from that mean, scaled by a
power of two so that none overflows, summed the same way.

Defined results: NULL values are left out; no values give NULL; NULL keys are a
group; NaN, or infinities of both signs, give NaN; one sign of infinity gives
it. A sum beyond the largest double is infinite, its mean still finite. The
deviation of fewer than two values is NULL, that of non-finite values NaN.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.functions.columns import exact_mean, exact_stddev_samp

BIN = 32  # binary orders of magnitude a bin
LIMB = 43  # bits
LOWEST = -1074  # the exponent of the least double
BINS = (1024 - LOWEST) // BIN + 1
BASE = LOWEST - 53  # a value of bin b is a multiple of 2^(BIN * b + BASE)
SPECIAL = -1  # zeros and what is not finite


@dataclass(frozen=True)
class Exact:
    """An aggregate that ``grouped`` computes without regard to row order."""

    kind: str
    column: Column


def exact_sum_of(c: Column | str) -> Exact:
    return Exact("sum", F.col(c) if isinstance(c, str) else c)


def exact_mean_of(c: Column | str) -> Exact:
    return Exact("mean", F.col(c) if isinstance(c, str) else c)


def exact_stddev_of(c: Column | str) -> Exact:
    return Exact("stddev", F.col(c) if isinstance(c, str) else c)


def _times_power(x: Column, exponent: Column) -> Column:
    """``x * 2^exponent`` in two steps, as one factor might not be a double."""
    half = F.floor(exponent / F.lit(2))
    two = F.lit(2.0)
    return x * F.pow(two, half.cast("double")) * F.pow(two, (exponent - half).cast("double"))


def _binned(values: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` (keys, ``_m``, ``_x`` double, not NULL) as limb sums per bin."""
    size = F.abs("_x")
    finite = ~F.isnan("_x") & (size < F.lit(float("inf"))) & (size > 0)
    # log2 may be off in its last place: a value then sits one bin aside, which
    # the 53 spare bits of BASE and the 86 bits of two limbs allow for.
    place = F.floor((F.log2(size) - F.lit(LOWEST)) / F.lit(BIN))
    bins = F.when(finite, F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))).otherwise(SPECIAL)
    rows = values.withColumn("_b", bins.cast("int"))
    whole = _times_power(F.col("_x"), -(F.col("_b") * BIN + F.lit(BASE)))
    rows = rows.withColumn("_w", F.when(F.col("_b") >= 0, whole).otherwise(0.0))
    unit = F.lit(float(1 << LIMB))
    high = F.floor(F.col("_w") / unit)
    low = F.col("_w") - high.cast("double") * unit
    return rows.groupBy(*keys, "_m", "_b").agg(
        F.sum(high.cast("decimal(18,0)")).alias("high"),
        F.sum(low.cast("bigint").cast("decimal(18,0)")).alias("low"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(~F.isnan("_x"), size)).alias("most"),
        F.max(F.when(F.isnan("_x"), 1).otherwise(0)).alias("nan"),
        F.max(F.when(F.col("_x") == float("inf"), 1).otherwise(0)).alias("plus"),
        F.max(F.when(F.col("_x") == float("-inf"), 1).otherwise(0)).alias("minus"),
    )


def _added(bins: Column, shift: int) -> Column:
    """The sum of a key's ``bins`` (a map from bin to its limbs), times 2^shift."""
    step = F.lit(1 << BIN).cast("decimal(11,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    limb = F.lit(1 << LIMB).cast("decimal(14,0)")

    def carried(state: Column, b: Column) -> Column:
        own = F.element_at(bins, b)
        value = (own["high"] * limb + own["low"]).cast("decimal(38,0)")
        total = (F.coalesce(value, zero) + state["carry"]).cast("decimal(38,0)")
        digit = F.pmod(total, step).cast("decimal(38,0)")
        # The division is exact, so its rounding to whole numbers is none.
        carry = F.call_function("div", (total - digit).cast("decimal(38,0)"), step).cast("decimal(38,0)")
        return F.struct(
            carry.alias("carry"), F.concat(state["digits"], F.array(digit.cast("double"))).alias("digits")
        )

    first = F.struct(zero.alias("carry"), F.array().cast("array<double>").alias("digits"))
    keys = F.filter(F.map_keys(bins), lambda b: b >= 0)
    lowest = F.coalesce(F.array_min(keys), F.lit(0))
    # Above the highest bin only the carry is left; two digits hold it, with its sign.
    last = F.coalesce(F.array_max(keys), F.lit(0))
    state = F.aggregate(F.sequence(lowest, last), first, carried)

    def joined(total: Column, at: Column) -> Column:
        exponent = (lowest + at) * BIN + F.lit(BASE + shift)
        return total + _times_power(F.element_at(state["digits"], at + 1), exponent)

    top = _times_power(state["carry"].cast("double"), (last + 1) * BIN + F.lit(BASE + shift))
    places = F.reverse(F.sequence(F.lit(0), last - lowest))
    return F.aggregate(places, top, joined)


def _sums(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and measure: ``sum``, ``mean``, ``n`` and ``most``, the largest size."""
    per_bin = _binned(values, keys)
    met = per_bin.groupBy(*keys, "_m").agg(
        F.map_from_entries(F.collect_list(F.struct("_b", F.struct("high", "low")))).alias("bins"),
        F.sum("n").alias("n"),
        *[F.max(c).alias(c) for c in ("most", "nan", "plus", "minus")],
    )
    odd = (
        F.when((F.col("nan") == 1) | (F.col("plus") + F.col("minus") == 2), float("nan"))
        .when(F.col("plus") == 1, float("inf"))
        .when(F.col("minus") == 1, float("-inf"))
    )
    met = met.withColumns({"sum": F.coalesce(odd, _added(F.col("bins"), 0)), "odd": odd})
    # Beyond the largest double the mean comes from the sum times 2^-64.
    small = _added(F.col("bins"), -64) / F.col("n") * F.lit(2.0**64)
    beyond = F.col("odd").isNull() & (F.abs("sum") == float("inf"))
    mean = F.when(beyond, small).otherwise(F.col("sum") / F.col("n"))
    return met.select(*keys, "_m", "sum", mean.alias("mean"), "n", "most")


def _wide(sums: DataFrame, keys: list[str], fields: Sequence[tuple[int, str, str]]) -> DataFrame:
    picked = [F.max(F.when(F.col("_m") == m, F.col(field))).alias(name) for m, field, name in fields]
    return sums.groupBy(*keys).agg(*picked)


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which NULL equals NULL."""
    named = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_r{i}"))
    return left.join(named, same, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def _is_exact(kind: str, dtype: T.DataType) -> bool:
    if isinstance(dtype, T.DecimalType):
        return kind != "stddev" or dtype.precision <= 18
    return isinstance(dtype, T.IntegralType) and kind != "stddev"


def grouped(
    df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column | Exact]
) -> DataFrame:
    """``df.groupBy(keys).agg(aggregates)`` in which the ``Exact`` ones have the
    same bits whatever the partitioning, for doubles too.

    Integers and decimals stay in the plain aggregate. Deviations of integers and
    of decimals over 18 digits are taken as those of doubles.
    """
    keys = list(keys)
    plain: dict[str, Column] = {}
    binned: dict[str, Exact] = {}
    for name, a in aggregates.items():
        if not isinstance(a, Exact):
            plain[name] = a
            continue
        dtype = df.select(a.column).schema[0].dataType
        if not _is_exact(a.kind, dtype):
            binned[name] = a
        elif a.kind == "sum":
            plain[name] = F.sum(a.column)
        elif a.kind == "mean":
            plain[name] = exact_mean(a.column)
        else:
            plain[name] = exact_stddev_samp(a.column, dtype.scale)
    quoted = [f"`{k}`" for k in keys]
    base = df.groupBy(*quoted).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in plain.items()])
    if not binned:
        return base.select(*quoted, *aggregates)

    # One measure per different column, all in long form.
    names = list(binned)
    own = [f"_k{i}" for i in range(len(keys))]
    values = df.select(
        *[F.col(q).alias(o) for q, o in zip(quoted, own)],
        *[binned[n].column.cast("double").alias(f"_v{i}") for i, n in enumerate(names)],
    )
    means = _sums(_long(values, own, range(len(names))), own)
    fields = [(i, "sum" if binned[n].kind == "sum" else "mean", f"_f{i}") for i, n in enumerate(names)]
    spread = [i for i, n in enumerate(names) if binned[n].kind == "stddev"]
    fields += [(i, "most", f"_most{i}") for i in spread] + [(i, "n", f"_n{i}") for i in spread]
    found = _wide(means, own, fields)
    if spread:
        centred = _met(values, found, own)
        for i in spread:
            scale = _scale(F.col(f"_most{i}"))
            off = _times_power(F.col(f"_v{i}"), scale) - _times_power(F.col(f"_f{i}"), scale)
            centred = centred.withColumn(f"_d{i}", off)
        squares = centred.select(
            *own,
            *[F.col(f"_d{i}").alias(f"_v{2 * i}") for i in spread],
            *[(F.col(f"_d{i}") * F.col(f"_d{i}")).alias(f"_v{2 * i + 1}") for i in spread],
        )
        measures = [m for i in spread for m in (2 * i, 2 * i + 1)]
        around = _wide(
            _sums(_long(squares, own, measures), own), own, [(m, "sum", f"_s{m}") for m in measures]
        )
        found = _met(found, around, own)
        for i in spread:
            n, off, sq = F.col(f"_n{i}"), F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
            root = F.sqrt(F.greatest(sq - off * off / n, F.lit(0.0)) / (n - 1))
            spread_of = F.when(n > 1, _times_power(root, -_scale(F.col(f"_most{i}"))))
            # A mean that is not finite makes every distance NaN.
            found = found.withColumn(f"_f{i}", spread_of)
    found = found.select(
        *[F.col(o).alias(k) for o, k in zip(own, keys)],
        *[F.col(f"_f{i}").alias(n) for i, n in enumerate(names)],
    )
    return _met(base, found, keys).select(*quoted, *[f"`{n}`" for n in aggregates])


def _scale(most: Column) -> Column:
    """The exponent that brings values of size ``most`` near 1."""
    ordinary = (most > 0) & (most < float("inf"))
    return F.when(ordinary, -F.floor(F.log2(most))).otherwise(F.lit(0)).cast("int")


def _long(values: DataFrame, keys: list[str], measures: Sequence[int]) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("_m"), F.col(f"_v{m}").alias("_x")) for m in measures]
    rows = values.select(*keys, F.inline(F.array(*entries)))
    return rows.where(F.col("_x").isNotNull())
