"""Fixed schemas. Production reads never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

from freightlens.constants import RAW_DATE_FORMAT  # noqa: F401 (re-exported)

# Raw order-line columns the analysis reads, with the names the source export
# uses. Money and rates are decimals so sums are exact and order independent;
# the export prints up to nine significant digits of single-precision values,
# so they have twelve fraction digits.
MONEY = T.DecimalType(24, 12)
RATE = T.DecimalType(18, 12)
RAW_ORDER_LINE_SCHEMA = T.StructType(
    [
        T.StructField("Order Id", T.LongType()),
        T.StructField("order date (DateOrders)", T.StringType()),
        T.StructField("shipping date (DateOrders)", T.StringType()),
        T.StructField("Days for shipping (real)", T.IntegerType()),
        T.StructField("Days for shipment (scheduled)", T.IntegerType()),
        T.StructField("Delivery Status", T.StringType()),
        T.StructField("Late_delivery_risk", T.IntegerType()),
        T.StructField("Shipping Mode", T.StringType()),
        T.StructField("Market", T.StringType()),
        T.StructField("Order Region", T.StringType()),
        T.StructField("Sales", MONEY),
        T.StructField("Order Profit Per Order", MONEY),
        T.StructField("Product Card Id", T.LongType()),
        T.StructField("Order Item Quantity", T.LongType()),
        T.StructField("Category Name", T.StringType()),
        T.StructField("Order Status", T.StringType()),
        T.StructField("Customer Segment", T.StringType()),
        T.StructField("Order Item Discount Rate", RATE),
        T.StructField("Order Item Profit Ratio", RATE),
        T.StructField("Product Name", T.StringType()),
        T.StructField("Order Country", T.StringType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
    ]
)


# Inventory snapshot, one row per product.
INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("avg_daily_demand_30d", T.DoubleType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("revenue_quartile", T.StringType()),
        T.StructField("days_of_stock", T.DoubleType()),
        T.StructField("simulated_stock", T.LongType()),
        T.StructField("stock_status", T.StringType()),
        T.StructField("priority_critical", T.BooleanType()),
    ]
)

# Route-segment lookup, one row per segment.
ROUTE_LOOKUP_SCHEMA = T.StructType(
    [
        T.StructField("route_segment", T.StringType()),
        T.StructField("total_shipments", T.LongType()),
        T.StructField("avg_delay", T.DoubleType()),
        T.StructField("late_count", T.LongType()),
        T.StructField("avg_sales", T.DoubleType()),
        T.StructField("avg_profit", T.DoubleType()),
        T.StructField("on_time_rate", T.DoubleType()),
    ]
)
