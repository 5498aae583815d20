"""Radix selection against sorted values."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import numpy as np
import pytest

from freightlens.operators.selection import exact_quantiles, values_at

ALL = lambda n: range(0, n, max(1, n // 7))


def _check(spark, values, kind, buckets):
    df = spark.createDataFrame([(v, "x") for v in values], f"v {kind}, w string")
    got, n = values_at(df.repartition(5), "v", lambda n: [*ALL(n), n - 1], buckets)
    key = lambda x: (x != x, x)  # noqa: E731  NaN last
    want = sorted((v for v in values if v is not None), key=key)
    assert n == len(want)
    for k, v in got.items():
        assert v == want[k] or (v != v and want[k] != want[k]), (k, v, want[k])


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_whole_numbers(spark, buckets):
    rng = random.Random(1)
    values = [rng.choice([0, 5, -3, rng.randint(-(2**63), 2**63 - 1)]) for _ in range(80)] + [None, -(2**63), 2**63 - 1]
    _check(spark, values, "long", buckets)


def test_decimals_of_any_width(spark):
    rng = random.Random(2)
    short = [Decimal(rng.randint(-10**6, 10**6)).scaleb(-2) for _ in range(300)] + [Decimal("3.14")] * 200
    _check(spark, short, "decimal(12,2)", 16)
    wide = [Decimal(rng.randint(-10**23, 10**23)).scaleb(-12) for _ in range(60)]
    _check(spark, wide, "decimal(24,12)", 4096)


def test_doubles_of_any_size(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(60)]
    values += [0.0, -0.0, 1.0, math.nextafter(1.0, 2), 5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, None]
    values += [2.5] * 40 + [100 + k / 7 for k in range(50)]
    _check(spark, values, "double", 64)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(4)
    values = [round(rng.gauss(50, 20), 2) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    row = exact_quantiles(df, "v", probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)


def test_without_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", {"a": 0.5}).first()["a"] is None


def test_no_value_is_shuffled(spark, tmp_path):
    from freightlens.operators import outliers
    from freightlens.plans import tables as P
    from tests.conftest import SF_SMALL
    from tests.test_plans import _plan

    text = _plan(outliers.iqr_anomalies(P.view(spark, SF_SMALL), col="Sales"))
    assert "Window" not in text and "hashpartitioning" not in text
