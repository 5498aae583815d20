"""Adapter: TPC-H style test tables -> raw order lines.

The analysis starts from a denormalised export with one row per order line
and several lines per order. The test tables are a star schema, so this module
joins them into that shape. One output row per ``lineitem`` row; the mapping
rules are the ones in FIXTURES.md section 2.

Plan shape (checked with ``explain``): the order side
``orders - customer - nation - region`` and the line side ``lineitem - part``
are built separately and meet in one equi-join on the order key. Every
dimension join (part, customer, nation, region) is left to the planner: it
broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge joins, with
AQE splitting skewed partitions. No broadcast is forced.

The pieces (``lineitem_lines``, ``order_side``, ``part_side``,
``to_raw_layout``) are exposed separately so the test-table plan can keep the first
line per order on narrow lineitem rows, before the part and order joins (see
``plans.tables.first_order_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.plans.session import materialise
from freightlens.sources.schemas import RAW_DATE_FORMAT

# Column that orders the lines of one order; the cleaning step keeps the
# smallest one per order ("first line").
LINE_SORT_KEY = "line_sort_key"

# Fixed values of the test mapping: scheduled days per order-priority digit.
SCHEDULED_DAYS_BY_PRIORITY = {1: 1, 2: 2, 3: 4, 4: 5, 5: 6}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _scheduled_days(priority_digit: Column) -> Column:
    expr = None
    for digit, days in SCHEDULED_DAYS_BY_PRIORITY.items():
        cond = priority_digit == F.lit(digit)
        expr = F.when(cond, F.lit(days)) if expr is None else expr.when(cond, F.lit(days))
    return expr.cast("int")


# Columns that order the lines of one order ("first line" = smallest).
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rows whose part exists, narrow (no part names yet).

    Part keys without a part are found first, on one column: the distinct keys
    of lineitem (combined map-side) less those of ``part``. Sound data leaves
    that set empty and needs no join, so its wide rows are never shuffled by
    part key; else the set is written to the shared folder and lineitem
    anti-joined with it, broadcast if its measured size allows. A NULL part key
    has no part either.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    li = li.where(F.col("l_partkey").isNotNull())
    used = li.select(F.col("l_partkey").alias("_orphan")).distinct()
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_orphan"))
    orphans = used.join(parts, "_orphan", "left_anti")
    if orphans.isEmpty():
        return li
    orphans = materialise(spark, orphans, "orphan_parts")
    return li.join(orphans, F.col("l_partkey") == F.col("_orphan"), "left_anti")


def part_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part attributes the raw layout carries: name and type."""
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")


def order_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level inputs: ``orders`` with customer, nation and region."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment"
    )
    nation = read_table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", "n_regionkey"
    )
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
            "c_mktsegment", "n_nationkey", "n_name", "r_name",
        )
    )


def to_raw_layout(
    lines: DataFrame, orders: DataFrame, parts: DataFrame, parts_first: bool = False
) -> DataFrame:
    """Join lines with their order (order key) and part (part key) and map
    them to the raw export layout (plus ``line_sort_key``).

    The order join comes first: lines that are already partitioned by the
    order key (after the first-line step) then move at most once more, for
    the part join, and not at all when the part side is broadcast. Lines that
    are not partitioned yet and whose result is wanted by order take the part
    join first (``parts_first``): the order join then leaves them dealt by the
    order key, and the wide rows of the layout do not move.
    """
    on_order = F.col("l_orderkey") == F.col("o_orderkey")
    on_part = F.col("l_partkey") == F.col("p_partkey")
    if parts_first:
        joined = lines.join(parts, on_part).join(orders, on_order)
    else:
        joined = lines.join(orders, on_order).join(parts, on_part)
    key = F.col("l_orderkey")
    priority_digit = F.substring("o_orderpriority", 1, 1).cast("int")
    real_days = (
        F.lit(1)
        + F.abs(F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))) % 7
        + F.when(key % 41 == 0, F.lit(15)).otherwise(F.lit(0))
    ).cast("int")
    scheduled_days = _scheduled_days(priority_digit)
    delay = real_days - scheduled_days
    delivery_status = (
        F.when(delay > 0, F.lit("Late delivery"))
        .when(delay < 0, F.lit("Advance shipping"))
        .when(key % 5 == 0, F.lit("On Time "))
        .otherwise(F.lit("Shipping on time"))
    )
    late_risk = F.when((delay > 0) & (key % 17 != 0), F.lit(1)).otherwise(F.lit(0))
    order_status = (
        F.when(
            F.col("o_orderstatus") == "P",
            F.when(key % 10 == 0, F.lit("CANCELED"))
            .when(key % 10 == 1, F.lit("SUSPECTED_FRAUD"))
            .otherwise(F.lit("PENDING")),
        )
        .when(F.col("o_orderstatus") == "F", F.lit("COMPLETE"))
        .when(F.col("o_orderstatus") == "O", F.lit("PROCESSING"))
    )
    sales = F.col("l_extendedprice").cast("decimal(12,2)")
    ratio_pct = (
        (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + key * 7) % 100
        - 10
        - 20 * ((F.col("n_nationkey") * 3 + F.length("p_type") + priority_digit) % 4)
    )
    profit_ratio = (
        ratio_pct.cast("decimal(5,0)") * F.lit(0.01).cast("decimal(3,2)")
    ).cast("decimal(5,2)")
    profit = (sales * profit_ratio).cast("decimal(16,4)")
    nk = F.col("n_nationkey")

    return joined.select(
        key.alias("Order Id"),
        F.date_format("o_orderdate", RAW_DATE_FORMAT).alias("order date (DateOrders)"),
        F.date_format("l_shipdate", RAW_DATE_FORMAT).alias("shipping date (DateOrders)"),
        real_days.alias("Days for shipping (real)"),
        scheduled_days.alias("Days for shipment (scheduled)"),
        delivery_status.alias("Delivery Status"),
        late_risk.cast("int").alias("Late_delivery_risk"),
        F.col("o_orderpriority").alias("Shipping Mode"),
        F.col("r_name").alias("Market"),
        F.col("n_name").alias("Order Region"),
        sales.alias("Sales"),
        profit.alias("Order Profit Per Order"),
        F.col("l_partkey").alias("Product Card Id"),
        F.col("l_quantity").cast("bigint").alias("Order Item Quantity"),
        F.col("p_type").alias("Category Name"),
        order_status.alias("Order Status"),
        F.col("c_mktsegment").alias("Customer Segment"),
        F.col("l_discount").cast("decimal(4,2)").alias("Order Item Discount Rate"),
        profit_ratio.alias("Order Item Profit Ratio"),
        F.col("p_name").alias("Product Name"),
        F.col("n_name").alias("Order Country"),
        ((nk * 7) % 120 - 60).cast("double").alias("Latitude"),
        ((nk * 13) % 360 - 180).cast("double").alias("Longitude"),
        F.struct(*LINE_ORDER).alias(LINE_SORT_KEY),
    )


def raw_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines in the export layout (column names with blanks,
    dates as ``M/d/yyyy H:mm`` text), one per line, plus ``line_sort_key``."""
    return to_raw_layout(
        lineitem_lines(spark, sf_dir),
        order_side(spark, sf_dir),
        part_side(spark, sf_dir),
        parts_first=True,
    )


def stock_days_rule(product_id: Column) -> Column:
    """Days of stock per product for the test data (an input, not a draw)."""
    return (F.lit(1) + (product_id * 7919 + 104729) % 120).cast("double")
