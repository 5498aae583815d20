"""Aggregates of doubles: the same bits for every partitioning, the exact sum."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from freightlens.functions.exact import exact_mean_of, exact_stddev_of, exact_sum_of, grouped
from freightlens.operators import margins, scoring
from freightlens.plans import tables as P
from tests.conftest import SF_SMALL


def aggregates():
    return {
        "rows": F.count(F.lit(1)),
        "total": exact_sum_of("x"),
        "mean": exact_mean_of("x"),
        "dev": exact_stddev_of("x"),
    }


def bits(row):
    return tuple(struct.pack("<d", v) if isinstance(v, float) else v for v in row)


def groups():
    rng = random.Random(11)
    out = {
        "money": [round(rng.uniform(-500, 900), 2) for _ in range(3000)],
        "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(2000)],
        "cancels": [1e300, 1.0, -1e300, 1e-300, 0.5, -0.5],
        "tiny": [5e-324, 5e-324, -1e-310, 2.3e-308],
        "huge": [1.7e308, 1.6e308, 1.5e308],
        "million": [1_000_000.5 + i for i in range(50)],
        "powers": [s * 2.0**e for e in range(-1074, 1023) for s in (1, -1)] + [3.0],
        "carries": [2.0**32] * 700 + [-1.0] * 700,
        "zeros": [0.0, -0.0, 0.0],
        "one": [4.25],
    }
    return out


def truth(xs):
    exact = sum((Fraction(x) for x in xs), Fraction(0))
    n = len(xs)
    mean = exact / n
    squares = sum((Fraction(x) - mean) ** 2 for x in xs)
    return exact, mean, squares / (n - 1) if n > 1 else None


def as_double(f):
    try:
        return float(f)
    except OverflowError:
        return math.inf if f > 0 else -math.inf


def test_sums_equal_exact_arithmetic(spark):
    data = groups()
    rows = [(g, x) for g, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in grouped(df, ["g"], aggregates()).collect()}
    assert set(got) == set(data)
    for g, xs in data.items():
        exact, mean, var = truth(xs)
        total = as_double(exact)
        assert got[g].rows == len(xs)
        if math.isinf(total):
            assert got[g].total == total, g
        else:
            assert abs(got[g].total - total) <= math.ulp(total), g
        assert abs(got[g].mean - float(mean)) <= 2 * math.ulp(float(mean)), g
        if var is None:
            assert got[g].dev is None
        elif var == 0:
            assert got[g].dev == 0.0
        else:
            # The root in whole numbers, as the variance may be beyond a double.
            places = 10**700
            dev = Fraction(math.isqrt(int(var * places**2)), places)
            assert abs(Fraction(got[g].dev) - dev) <= max(dev / 10**13, Fraction(5e-324)), g


@pytest.mark.parametrize("n", [17, 40])
def test_partitioning_does_not_change_a_bit(spark, n):
    rows = [(g, x) for g, xs in groups().items() for x in xs]
    random.Random(n).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    one = sorted(map(bits, grouped(df.repartition(1), ["g"], aggregates()).collect()))
    many = sorted(map(bits, grouped(df.repartition(n), ["g"], aggregates()).collect()))
    assert one == many


def test_nulls_specials_and_empty(spark):
    inf, nan = math.inf, math.nan
    rows = [("n", None), (None, 1.5), (None, 2.5), (None, None), ("i", inf), ("i", 1.0), ("m", -inf)]
    rows += [("b", inf), ("b", -inf), ("q", nan), ("q", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in grouped(df, ["g"], aggregates()).collect()}
    assert (got["n"].rows, got["n"].total, got["n"].mean, got["n"].dev) == (1, None, None, None)
    assert (got[None].rows, got[None].total, got[None].mean) == (3, 4.0, 2.0)
    assert got[None].dev == pytest.approx(math.sqrt(0.5))
    assert got["i"].total == inf and math.isnan(got["i"].dev)
    assert got["m"].total == -inf and got["m"].dev is None
    assert math.isnan(got["b"].total) and math.isnan(got["q"].total) and math.isnan(got["q"].dev)
    assert grouped(df.limit(0), ["g"], aggregates()).collect() == []
    whole = grouped(df.where("g is null"), [], aggregates()).collect()
    assert [(r.rows, r.total) for r in whole] == [(3, 4.0)]


def test_clashing_names_and_several_measures(spark):
    df = spark.createDataFrame([("a", 1.5, 2, "u"), ("a", 2.5, 3, "v")], "`_m` string, `_b` double, n long, most string")
    wanted = {"s": exact_sum_of("_b"), "t": exact_sum_of("n"), "d": exact_stddev_of("n"), "top": F.max("most")}
    got = grouped(df, ["_m"], wanted).collect()[0].asDict()
    assert got == {"_m": "a", "s": 4.0, "t": 5, "d": pytest.approx(math.sqrt(0.5)), "top": "v"}


def test_decimals_keep_the_plain_plan(spark):
    df = spark.createDataFrame([("a", 1)], "g string, x int").select("g", F.col("x").cast("decimal(18,12)"))
    plan = grouped(df, ["g"], aggregates())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


@pytest.mark.parametrize("op", ["segment_metrics", "corridor_metrics", "cost_erosion", "route_lookup"])
def test_operators_on_doubles(spark, op):
    """With double measures: as with decimals up to rounding, and the same bits
    for any partitioning."""
    names = ["Sales", "Order_Profit_Per_Order", "implied_total_cost", "Order_Item_Discount_Rate", "Order_Item_Profit_Ratio"]
    if op == "route_lookup":
        table, run = P.shipments(spark, SF_SMALL), margins.route_lookup
    else:
        table = P.view(spark, SF_SMALL)
        fn = getattr(margins if op == "cost_erosion" else scoring, op)
        run = lambda t: fn(t, 2)
    doubles = table.withColumns({c: F.col(c).cast("double") for c in names if c in table.columns})
    one = sorted(map(bits, run(doubles.repartition(1)).collect()), key=repr)
    many = sorted(map(bits, run(doubles.repartition(17)).collect()), key=repr)
    assert one == many and one
    want = sorted(run(table).collect(), key=lambda r: repr(r[:4]))
    got = sorted(run(doubles).collect(), key=lambda r: repr(r[:4]))
    assert len(want) == len(got)
    for w, g in zip(want, got):
        for a, b in zip(w, g):
            assert a == b if not isinstance(a, float) else a == pytest.approx(b, abs=0.011, rel=1e-9)
