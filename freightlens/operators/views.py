"""The shared ``delivery_analysis`` view and its validation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightlens.constants import STATUS_EARLY, STATUS_LATE, STATUS_ON_TIME
from freightlens.functions.columns import round_half_up

VIEW_NAME = "delivery_analysis"


def delivery_analysis(shipments: DataFrame) -> DataFrame:
    """The 30-column view every analysis reads.

    Renames the lead-time and status columns and recomputes the delivery
    status from ``delay_days`` with a NULL result for a NULL delay (unlike
    ``calculated_status`` on the shipments table, which says 'On Time').
    """
    d = F.col("delay_days")
    return shipments.select(
        "Order_Id",
        "order_date",
        "shipping_date",
        "actual_delivery_date",
        "scheduled_delivery_date",
        F.col("Days_for_shipping_real").alias("actual_lead_time_days"),
        F.col("Days_for_shipment_scheduled").alias("scheduled_lead_time_days"),
        "delay_days",
        F.when(d > 0, F.lit(STATUS_LATE))
        .when(d == 0, F.lit(STATUS_ON_TIME))
        .when(d < 0, F.lit(STATUS_EARLY))
        .alias("calc_delivery_status"),
        F.col("Delivery_Status").alias("original_delivery_status"),
        "Late_delivery_risk",
        "Shipping_Mode",
        "Market",
        "Order_Region",
        "route_segment",
        "Category_Name",
        "Order_Status",
        "Customer_Segment",
        "Sales",
        "Order_Profit_Per_Order",
        "implied_total_cost",
        "cost_pct_revenue",
        "Order_Item_Discount_Rate",
        "Order_Item_Profit_Ratio",
        "Product_Card_Id",
        "Product_Name",
        "Order_Item_Quantity",
        "Latitude",
        "Longitude",
        "Order_Country",
    )


def publish_view(df: DataFrame, name: str = VIEW_NAME) -> DataFrame:
    """Register ``df`` as a temp view, replacing an older one of that name."""
    df.createOrReplaceTempView(name)
    return df


def row_count(da: DataFrame) -> DataFrame:
    return da.agg(F.count(F.lit(1)).alias("total_rows"))


def status_breakdown(da: DataFrame) -> DataFrame:
    """Orders per computed status and their share of all orders, as
    ``decimal(5,2)``.

    The share of the total is a window over the *aggregated* rows (one per
    status, at most four), so the single-partition window sees four rows.
    """
    counts = da.groupBy("calc_delivery_status").agg(F.count(F.lit(1)).alias("order_count"))
    total = F.sum("order_count").over(Window.partitionBy())
    pct = round_half_up(F.col("order_count") * F.lit(100.0) / total, 2).cast("decimal(5,2)")
    return counts.withColumn("pct", pct).orderBy(
        F.col("order_count").desc(), F.col("calc_delivery_status").asc_nulls_first()
    )


def status_crosstab(da: DataFrame) -> DataFrame:
    """Orders per (computed status, original status)."""
    return (
        da.groupBy("calc_delivery_status", "original_delivery_status")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(
            F.col("calc_delivery_status").asc_nulls_first(),
            F.col("count").desc(),
            F.col("original_delivery_status").asc_nulls_first(),
        )
    )
