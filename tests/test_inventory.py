"""Demand, quartiles, bands, rolling cover, and the distributed rank."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freightlens.operators import inventory as inv
from freightlens.operators.ranking import quantile_bucket, rank_below


def test_stock_bands_edges(spark):
    df = spark.createDataFrame([(d,) for d in [7.0, 8.0, 14.0, 15.0, 60.0, 61.0, None]], "d double")
    got = [r[0] for r in df.select(inv.stock_band(F.col("d"))).collect()]
    assert got == ["Critical", "Warning", "Warning", "Healthy", "Healthy", "Overstocked", "Overstocked"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rank_below_brute_force(spark, seed):
    rng = random.Random(seed)
    vals = [rng.choice([None, rng.randint(0, 30), rng.randint(0, 5)]) for _ in range(300)]
    vals += [7] * 100  # one value holding a quarter of the rows
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    got = {r["id"]: (r["n_below"], r["n_valid"]) for r in rank_below(df, "v", buckets=8).collect()}
    valid = [v for v in vals if v is not None]
    for i, v in enumerate(vals):
        if v is None:
            assert got[i] == (None, None)
        else:
            assert got[i] == (sum(1 for w in valid if w < v), len(valid))


@pytest.mark.parametrize("seed", [0, 1, 2, 3, 4])
def test_quantile_bucket_matches_qcut(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 200))
    vals = np.round(rng.gamma(2.0, 50.0, n), 2)
    if seed % 2:
        vals[: n // 3] = vals[0]  # heavy ties
    labels = ["Q1_Low", "Q2_Med", "Q3_High", "Q4_Top"]
    try:
        expected = pd.qcut(vals, 4, labels=labels).astype(str).tolist()
    except ValueError:  # repeated edges: lower bin by rule
        edges = np.quantile(vals, [0.25, 0.5, 0.75])
        expected = [labels[next((k for k, e in enumerate(edges) if v <= e), 3)] for v in vals]
    df = spark.createDataFrame([(i, Decimal(str(v))) for i, v in enumerate(vals)], "id int, v decimal(12,2)")
    ranked = rank_below(df, "v", buckets=4)
    out = ranked.select("id", quantile_bucket(F.col("n_below"), F.col("n_valid"), labels).alias("q"))
    got = {r["id"]: r["q"] for r in out.collect()}
    assert [got[i] for i in range(n)] == expected


def _shipments(spark, rows):
    return spark.createDataFrame(
        rows,
        "Order_Id long, Product_Card_Id long, order_date timestamp_ntz, Order_Item_Quantity long, "
        "Category_Name string, Sales decimal(12,2)",
    )


def test_inventory_build_demand_category_stock(spark):
    d1, d2 = dt.datetime(2018, 1, 1, 9), dt.datetime(2018, 1, 2, 9)
    rows = [
        (1, 10, d1, 2, "Books ", Decimal("10.00")),
        (2, 10, d1, 4, "Other", Decimal("10.00")),
        (3, 10, d2, 3, "Other", Decimal("10.00")),
        (4, 20, d1, 5, None, Decimal("1.00")),
        (5, 20, None, 9, "Late cat", Decimal("1.00")),
        (6, 30, d2, 1, "X", Decimal("100.00")),
        (7, 40, d2, 1, "Y", Decimal("50.00")),
    ]
    days = spark.createDataFrame([(10, 7.0), (20, 14.0), (30, 3.0), (40, 61.0)],
                                 "product_id long, days_of_stock double")
    out = {r["product_id"]: r for r in inv.inventory_build(_shipments(spark, rows), days).collect()}
    assert out[10]["avg_daily_demand_30d"] == 4.5  # (6 + 3) / 2 active days
    assert out[10]["category_name"] == "Books "  # first by order id, blanks kept
    assert out[20]["avg_daily_demand_30d"] == 5.0  # the undated row is not demand
    assert out[20]["category_name"] == "Late cat"  # ... but still names the category
    assert out[10]["simulated_stock"] == 31  # int(4.5 * 7)
    assert out[10]["stock_status"] == "Critical"
    assert out[40]["stock_status"] == "Overstocked"
    # revenue 30, 2, 100, 50 -> quartiles by rank
    assert out[30]["revenue_quartile"] == "Q4_Top" and out[20]["revenue_quartile"] == "Q1_Low"
    assert out[30]["priority_critical"] is True  # Critical (3 days) and top quartile
    assert out[10]["priority_critical"] is False


def test_rolling_cover_gap_and_no_demand(spark):
    start = dt.datetime(2018, 1, 1, 8)
    rows = [(i, 1, start + dt.timedelta(days=3 * i), i + 1, "C", Decimal("1.00")) for i in range(31)]
    da = _shipments(spark, rows)
    lr = inv.latest_rolling(da).collect()
    assert len(lr) == 1 and lr[0]["rolling_avg_demand_30d"] == sum(range(2, 32)) / 30
    inventory = spark.createDataFrame(
        [(1, 1.0, "C", "Q1_Low", 10.0, 165, "Warning", False),
         (2, 1.0, "D", "Q4_Top", 5.0, 5, "Critical", True)],
        "product_id long, avg_daily_demand_30d double, category_name string, "
        "revenue_quartile string, days_of_stock double, simulated_stock long, "
        "stock_status string, priority_critical boolean",
    )
    health = {r["product_id"]: r for r in inv.inventory_health(inventory, da).collect()}
    assert health[1]["adjusted_days_of_stock"] == 10.0  # 165 / 16.5
    assert health[2]["latest_rolling_demand"] == 0.0
    assert health[2]["adjusted_days_of_stock"] == 999.0


def test_stock_status_summary_lists_every_band(spark):
    inventory = spark.createDataFrame(
        [(1, "Critical"), (2, "Critical"), (3, "Healthy")], "product_id long, stock_status string"
    )
    got = {r["stock_status"]: (r["products"], r["pct"]) for r in inv.stock_status_summary(inventory).collect()}
    assert got == {
        "Critical": (2, 200.0 / 3), "Warning": (0, 0.0), "Healthy": (1, 100.0 / 3),
        "Overstocked": (0, 0.0),
    }
