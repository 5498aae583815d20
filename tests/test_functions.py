"""Column helpers: rounding, ratios, exact aggregates, strip, day arithmetic."""

from __future__ import annotations

import datetime as dt
import statistics
from decimal import Decimal

from freightlens.functions import columns as C


def test_round_half_up_edges(spark):
    vals = [1.025, 2.675, -1.025, 0.125, -4.5, 1e30, float("nan"), None, 1.00499999999999, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(C.round_half_up("x", 2)).collect()]
    assert got[:4] == [1.03, 2.68, -1.03, 0.13]
    assert got[4] == -4.5
    assert got[5] == 1e30  # one rule, whatever the size
    assert got[6] != got[6]  # NaN stays NaN
    assert got[7] is None
    assert got[8:] == [1.0, 1.01]  # rounded once, on the printed digits
    zero = [r[0] for r in df.select(C.round_half_up("x", 0)).collect()]
    assert zero[4] == -5.0  # half away from zero


def test_pct_of_zero_and_null(spark):
    df = spark.createDataFrame([(1, 4), (0, 0), (None, 3), (2, None)], "n long, d long")
    assert [r[0] for r in df.select(C.pct_of("n", "d")).collect()] == [25.0, None, None, None]


def test_exact_mean_and_stddev(spark):
    xs = ["0.10", "0.20", "0.30", "-0.70", "0.89"]
    df = spark.createDataFrame(
        [(Decimal(x), "a") for x in xs] + [(Decimal("0.50"), "b"), (None, "b"), (None, "c")],
        "x decimal(5,2), g string",
    )
    rows = {
        r["g"]: r
        for r in df.groupBy("g")
        .agg(C.exact_mean("x").alias("m"), C.exact_stddev_samp("x").alias("s"))
        .collect()
    }
    floats = [float(x) for x in xs]
    # exact decimal sum (0.79), one double division
    assert rows["a"]["m"] == float(sum(Decimal(x) for x in xs)) / 5
    assert abs(rows["a"]["s"] - statistics.stdev(floats)) < 1e-12
    assert rows["b"]["m"] == 0.5 and rows["b"]["s"] is None  # one value
    assert rows["c"]["m"] is None and rows["c"]["s"] is None  # no values


def test_exact_stddev_of_long_rates(spark):
    xs = [Decimal("0.289999992"), Decimal("-2.749999999"), Decimal("0.039999999"), Decimal("-0.5")]
    big = [Decimal("100000") + Decimal(i) / Decimal(10**9) for i in range(5)]
    df = spark.createDataFrame(
        [("a", x) for x in xs] + [("b", x) for x in big], "g string, x decimal(18,12)"
    )
    got = {r["g"]: r["s"] for r in df.groupBy("g").agg(C.exact_stddev_samp("x").alias("s")).collect()}
    for g, values in (("a", xs), ("b", big)):
        want = float(statistics.stdev(values))
        assert abs(got[g] - want) <= 1e-14 * want, (g, got[g], want)


def test_strip_py_whitespace(spark):
    vals = ["　 x y \n", "\x1c a\x85", "none", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(C.strip_py("s")).collect()]
    assert got == [v.strip() if v is not None else None for v in vals]


def test_add_days_and_parse(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 2, 28, 23, 30), 1), (dt.datetime(2020, 2, 28, 0, 0), -30), (None, 1)],
        "ts timestamp_ntz, d int",
    )
    got = [r[0] for r in df.select(C.add_days("ts", "d")).collect()]
    assert got == [dt.datetime(2020, 2, 29, 23, 30), dt.datetime(2020, 1, 29, 0, 0), None]
    t = spark.createDataFrame([("2/29/2020 7:05",), ("2/30/2020 7:05",)], "s string")
    parsed = [r[0] for r in t.select(C.parse_timestamp("s", "M/d/yyyy H:mm")).collect()]
    assert parsed == [dt.datetime(2020, 2, 29, 7, 5), None]
    assert dict(t.select(C.parse_timestamp("s", "M/d/yyyy H:mm").alias("p")).dtypes)["p"] == "timestamp_ntz"


def test_decimals_reported_as_double(spark):
    from freightlens.plans.catalog import decimals_as_double

    df = spark.createDataFrame([(Decimal("10.55"), 1)], "a decimal(12,2), b int")
    out = decimals_as_double(df)
    assert out.dtypes == [("a", "double"), ("b", "int")]
    assert out.first()["a"] == 10.55
    assert decimals_as_double(df.select("b")).dtypes == [("b", "int")]
