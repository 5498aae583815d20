"""Cleaning steps on small inline frames (NULL rules, dedup, names, dates)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from freightlens.functions.columns import sql_friendly_name
from freightlens.operators import clean
from freightlens.operators.views import delivery_analysis


def test_parse_dates_bad_text_is_null(spark):
    df = spark.createDataFrame(
        [("1/31/2018 22:56", "2/3/2018 0:05"), ("13/1/2018 1:00", "junk"), (None, "")],
        "`order date (DateOrders)` string, `shipping date (DateOrders)` string",
    )
    rows = clean.parse_dates(df).collect()
    assert rows[0]["order_date"] == dt.datetime(2018, 1, 31, 22, 56)
    assert rows[0]["shipping_date"] == dt.datetime(2018, 2, 3, 0, 5)
    assert rows[1]["order_date"] is None and rows[1]["shipping_date"] is None
    assert rows[2]["order_date"] is None
    assert clean.null_date_count(clean.parse_dates(df)).first()[0] == 2
    assert dict(clean.parse_dates(df).dtypes)["order_date"] == "timestamp_ntz"


def test_dedup_keeps_first_by_order_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 5, "x"), (None, 1, "n1"), (None, 0, "n0")],
        "id long, pos int, v string",
    )
    out = clean.dedup_first(df, ["id"], ["pos"])
    got = {r["id"]: r["v"] for r in out.collect()}
    assert got == {1: "a", 2: "x", None: "n0"}
    assert out.columns == df.columns
    again = clean.dedup_first(out, ["id"], ["pos"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    stats = clean.dedup_stats(df, "id").first()
    assert (stats["rows_before"], stats["rows_after"], stats["rows_removed"]) == (6, 3, 3)


def test_dedup_full_ties_pick_a_determined_row(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 0, "a")], "id long, pos int, v string")
    for n in (1, 2, 5):
        assert clean.dedup_first(df.repartition(n), ["id"], ["pos"]).first()["v"] == "a"


def test_derive_delivery_null_delay_rules(spark):
    df = spark.createDataFrame(
        [
            (dt.datetime(2018, 1, 1, 10, 0), 5, 2),
            (dt.datetime(2018, 1, 1, 10, 0), 2, 4),
            (dt.datetime(2018, 1, 1, 10, 0), 3, 3),
            (dt.datetime(2018, 1, 1, 10, 0), None, 3),
            (None, 1, 1),
        ],
        "order_date timestamp_ntz, `Days for shipping (real)` int, "
        "`Days for shipment (scheduled)` int",
    )
    rows = clean.derive_delivery(df).collect()
    assert [r["delay_days"] for r in rows] == [3, -2, 0, None, 0]
    assert [r["calculated_status"] for r in rows] == ["Late", "Early", "On Time", "On Time", "On Time"]
    assert rows[0]["actual_delivery_date"] == dt.datetime(2018, 1, 6, 10, 0)
    assert rows[0]["scheduled_delivery_date"] == dt.datetime(2018, 1, 3, 10, 0)
    assert rows[3]["actual_delivery_date"] is None
    assert rows[4]["actual_delivery_date"] is None


def test_view_status_is_null_for_null_delay(spark):
    cols = [
        "Order_Id", "order_date", "shipping_date", "actual_delivery_date",
        "scheduled_delivery_date", "Days_for_shipping_real", "Days_for_shipment_scheduled",
        "delay_days", "Delivery_Status", "Late_delivery_risk", "Shipping_Mode", "Market",
        "Order_Region", "route_segment", "Category_Name", "Order_Status", "Customer_Segment",
        "Sales", "Order_Profit_Per_Order", "implied_total_cost", "cost_pct_revenue",
        "Order_Item_Discount_Rate", "Order_Item_Profit_Ratio", "Product_Card_Id", "Product_Name",
        "Order_Item_Quantity", "Latitude", "Longitude", "Order_Country",
    ]
    df = spark.createDataFrame(
        [(i, d) for i, d in enumerate([2, 0, -1, None])], "Order_Id long, delay_days int"
    ).select(
        *[
            F.col(c) if c in ("Order_Id", "delay_days") else F.lit(None).cast("string").alias(c)
            for c in cols
        ]
    )
    out = delivery_analysis(df).orderBy("Order_Id").collect()
    assert [r["calc_delivery_status"] for r in out] == ["Late", "On Time", "Early", None]
    assert len(delivery_analysis(df).columns) == 30


def test_status_match_strips_source(spark):
    df = spark.createDataFrame(
        [("On Time", "On Time "), ("Late", " Late\t"), ("Early", "Advance shipping"), ("Late", None)],
        "calculated_status string, `Delivery Status` string",
    )
    r = clean.status_match(df).first()
    assert (r["matched"], r["total"]) == (2, 4)
    assert r["match_pct"] == 50.0


def test_route_segment_strip_null_and_cut(spark):
    long = "R" * 300
    df = spark.createDataFrame(
        [(" Standard Class ", "LATAM", "South of  USA\xa0"), ("First Class", None, "x"), ("A", "B", long)],
        "`Shipping Mode` string, Market string, `Order Region` string",
    )
    rows = clean.add_route_segment(df).collect()
    assert rows[0]["route_segment"] == "Standard Class > LATAM > South of  USA"
    assert rows[1]["route_segment"] is None
    assert len(rows[2]["route_segment"]) == 195


def test_segment_count_and_top(spark):
    df = spark.createDataFrame(
        [("a",), ("b",), ("b",), ("c",), ("c",), ("c",), (None,), ("d",), ("e",), ("f",)],
        "route_segment string",
    )
    assert clean.segment_count(df).first()[0] == 6
    top = [(r[0], r[1]) for r in clean.segment_top(df, 3).collect()]
    assert top == [("c", 3), ("b", 2), ("a", 1)]


def test_cost_metrics_zero_and_null_sales(spark):
    df = spark.createDataFrame(
        [(Decimal("100.00"), Decimal("20.0000")), (Decimal("0.00"), Decimal("-5.0000")),
         (None, Decimal("1.0000")), (Decimal("50.00"), None)],
        "Sales decimal(12,2), `Order Profit Per Order` decimal(16,4)",
    )
    rows = clean.add_cost_metrics(df).collect()
    assert rows[0]["implied_total_cost"] == Decimal("80.0000")
    assert rows[0]["cost_pct_revenue"] == 80.0
    assert rows[1]["cost_pct_revenue"] == 0.0
    assert rows[2]["cost_pct_revenue"] is None
    assert rows[3]["cost_pct_revenue"] is None
    neg = clean.negative_profit_share(df).first()
    assert (neg["negative_profit_orders"], neg["total_orders"]) == (1, 4)


def test_sql_friendly_names():
    assert sql_friendly_name("Days for shipping (real)") == "Days_for_shipping_real"
    assert sql_friendly_name("order date (DateOrders)") == "order_date_DateOrders"
    assert sql_friendly_name("Order Item Cardprod Id/x") == "Order_Item_Cardprod_Id_x"


def test_clean_shipments_end_to_end(spark):
    raw = spark.createDataFrame(
        [
            (7, "1/2/2018 10:30", "1/4/2018 10:30", 4, 2, "Late delivery", 1, "Second Class",
             "Europe", "West", Decimal("10.00"), Decimal("2.0000"), 1, 0),
            (7, "1/2/2018 10:30", "1/4/2018 10:30", 1, 2, "Advance shipping", 0, "Second Class",
             "Europe", "West", Decimal("99.00"), Decimal("1.0000"), 2, 1),
        ],
        "`Order Id` long, `order date (DateOrders)` string, `shipping date (DateOrders)` string, "
        "`Days for shipping (real)` int, `Days for shipment (scheduled)` int, "
        "`Delivery Status` string, Late_delivery_risk int, `Shipping Mode` string, Market string, "
        "`Order Region` string, Sales decimal(12,2), `Order Profit Per Order` decimal(16,4), "
        "`Product Card Id` long, pos int",
    )
    out = clean.clean_shipments(raw, order_by=["pos"], drop=["pos"]).collect()
    assert len(out) == 1
    r = out[0]
    assert r["Order_Id"] == 7 and r["Sales"] == Decimal("10.00")
    assert r["delay_days"] == 2 and r["calculated_status"] == "Late"
    assert r["route_segment"] == "Second Class > Europe > West"
    assert r["implied_total_cost"] == Decimal("8.0000") and r["cost_pct_revenue"] == 80.0
    assert r["order_date"] == dt.datetime(2018, 1, 2, 10, 30)


def test_parse_dates_ignores_session_time_zone(spark):
    df = spark.createDataFrame([("3/11/2018 2:30",), ("10/28/2018 2:30",)], "`order date (DateOrders)` string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/New_York", "Europe/Berlin", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r[0] for r in clean.parse_dates(df, {"d": "order date (DateOrders)"}).select("d").collect()]
            assert got == [dt.datetime(2018, 3, 11, 2, 30), dt.datetime(2018, 10, 28, 2, 30)], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dedup_hot_key_across_partitions(spark):
    import random

    rng = random.Random(11)
    rows = [(1, rng.randint(0, 10**6), f"h{i}") for i in range(3000)]  # one hot order
    rows += [(k, rng.randint(0, 100), f"o{k}-{j}") for k in range(2, 200) for j in range(3)]
    df = spark.createDataFrame(rows, "id long, pos int, v string").repartition(8)
    got = {r["id"]: (r["pos"], r["v"]) for r in clean.dedup_first(df, ["id"], ["pos"]).collect()}
    expected: dict[int, tuple[int, str]] = {}
    for k, p, v in rows:
        if k not in expected or (p, v) < expected[k]:
            expected[k] = (p, v)
    assert got == expected
