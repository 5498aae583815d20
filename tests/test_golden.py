"""Golden facts: a few rows of the published inventory snapshot and route
lookup, kept here as fixed constants, must follow from our formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightlens.operators import inventory as inv

# Fixed values: (product_id, avg_daily_demand_30d, revenue_quartile,
# days_of_stock, simulated_stock, stock_status, priority_critical).
INVENTORY_ROWS = [
    (19, 1.0833333333333333, "Q1_Low", 37.0, 40, "Healthy", False),
    (24, 3.3076923076923075, "Q2_Med", 65.0, 215, "Overstocked", False),
    (1346, 45.0, "Q3_High", 1.0, 45, "Critical", False),
    (666, 1.1219512195121952, "Q2_Med", 8.0, 8, "Warning", False),
    (924, 2.725, "Q1_Low", 4.0, 10, "Critical", False),
    (1350, 54.333333333333336, "Q4_Top", 101.0, 5487, "Overstocked", False),
]

# Fixed values: (total_shipments, late_count, on_time_rate).
ROUTE_ROWS = [
    (96, 89, 7.2916666666666625),
    (96, 94, 2.083333333333337),
    (155, 150, 3.2258064516129004),
    (197, 187, 5.076142131979699),
]


def test_inventory_rows_reproduce(spark):
    df = spark.createDataFrame(
        [r[:4] for r in INVENTORY_ROWS],
        "product_id long, avg_daily_demand_30d double, revenue_quartile string, days_of_stock double",
    )
    band = inv.stock_band(F.col("days_of_stock"))
    out = df.select(
        "product_id",
        (F.col("avg_daily_demand_30d") * F.col("days_of_stock")).cast("bigint").alias("stock"),
        band.alias("status"),
        ((band == "Critical") & (F.col("revenue_quartile") == "Q4_Top")).alias("priority"),
    ).collect()
    got = {r["product_id"]: (r["stock"], r["status"], r["priority"]) for r in out}
    assert got == {r[0]: (r[4], r[5], r[6]) for r in INVENTORY_ROWS}


def test_route_on_time_rate_reproduces(spark):
    df = spark.createDataFrame([r[:2] for r in ROUTE_ROWS], "total_shipments long, late_count long")
    rate = (F.lit(1.0) - F.col("late_count").cast("double") / F.col("total_shipments")) * F.lit(100.0)
    got = [r[0] for r in df.select(rate).collect()]
    assert got == [r[2] for r in ROUTE_ROWS]
