"""Demand, revenue quartiles, stock bands and stock cover.

Two entry points:

* ``inventory_build(shipments, days_of_stock)``: one row per product with mean
  daily demand, first category, revenue quartile, stock level and stock band.
  Days of stock is an input (a column over ``product_id`` or a
  ``(product_id, days_of_stock)`` frame), not a random draw.
* ``inventory_health(inventory, da, window=30)``: stock cover recomputed from
  the latest 30-row rolling mean of daily demand; 999 when there is no demand.

Plan notes. Daily demand is a two-level aggregate (product, day) -> product:
map-side partial sums, then one shuffle on (product, day), then a small one on
product. Category and revenue come from one aggregate on product. Those
frames are hash-partitioned on the product, so joining them adds no exchange.
The rolling and latest-row windows are partitioned by product, and their rows
are (product, day) aggregates: a product has at most one row per calendar day,
however many orders it has. Revenue quartiles use ``rank_below`` (no
single-task window over all products).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.constants import (
    NO_DEMAND_COVER,
    PRIORITY_BAND,
    PRIORITY_QUARTILE,
    QUARTILE_LABELS,
    ROLLING_ROWS,
    STOCK_BAND_OVER,
    STOCK_BANDS,
)
from freightlens.functions.columns import exact_mean, pct_of, round_half_up
from freightlens.operators.ranking import quantile_bucket, rank_below
from freightlens.plans.session import materialise


# --------------------------------------------------------------------------
# building blocks on cleaned shipments
# --------------------------------------------------------------------------
def daily_demand(
    da: DataFrame,
    product: str = "Product_Card_Id",
    ts: str = "order_date",
    qty: str = "Order_Item_Quantity",
) -> DataFrame:
    """Units ordered per (product, day). NULL keys are kept as a group."""
    return da.groupBy(F.col(product), F.to_date(ts).alias("order_day")).agg(
        F.sum(qty).alias("daily_qty")
    )


def avg_demand(
    shipments: DataFrame,
    product: str = "Product_Card_Id",
    ts: str = "order_date",
    qty: str = "Order_Item_Quantity",
) -> DataFrame:
    """Mean units per *active* day per product (days without orders do not
    count). Rows with a NULL product or date are left out; a day whose
    quantities are all NULL counts as 0 units."""
    daily = (
        shipments.where(F.col(product).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(product).alias("product_id"), F.to_date(ts).alias("_day"))
        .agg(F.coalesce(F.sum(qty), F.lit(0)).alias("_qty"))
    )
    return daily.groupBy("product_id").agg(exact_mean("_qty").alias("avg_daily_demand_30d"))


def product_facts(
    shipments: DataFrame,
    product: str = "Product_Card_Id",
    category: str = "Category_Name",
    sales: str = "Sales",
    order_key: str = "Order_Id",
) -> DataFrame:
    """Per product: first non-NULL category and total revenue.

    "First" is the row with the lowest ``order_key``: the position in the
    export for file input, else the order id. Revenue is the exact decimal
    sum; a product whose sales are all NULL has revenue 0.

    The shipments are first grouped by product and category, where the
    aggregates hold no text and so hash; the text is picked among a product's
    few categories.
    """
    cat = F.col("category_name")
    by_category = (
        shipments.where(F.col(product).isNotNull())
        .groupBy(F.col(product).alias("product_id"), F.col(category).alias("category_name"))
        .agg(F.min(order_key).alias("_first"), F.sum(sales).alias("_sales"))
    )
    return by_category.groupBy("product_id").agg(
        F.min_by(cat, F.when(cat.isNotNull(), F.col("_first"))).alias("category_name"),
        F.coalesce(F.sum("_sales"), F.lit(0)).alias("_revenue"),
    )


def product_category(shipments: DataFrame) -> DataFrame:
    return product_facts(shipments).select("product_id", "category_name")


def product_revenue(
    shipments: DataFrame, product: str = "Product_Card_Id", sales: str = "Sales"
) -> DataFrame:
    return (
        shipments.where(F.col(product).isNotNull())
        .groupBy(F.col(product).alias("product_id"))
        .agg(F.coalesce(F.sum(sales), F.lit(0)).cast("double").alias("total_revenue"))
    )


def with_revenue_quartile(
    facts: DataFrame, labels: Sequence[str] = QUARTILE_LABELS
) -> DataFrame:
    """Add ``revenue_quartile`` from ``_revenue``: bins at the interpolated
    quartiles, right-closed, equal revenues always in one bin, repeated edges
    resolved to the lower bin."""
    ranked = rank_below(facts, "_revenue")
    return ranked.withColumn(
        "revenue_quartile", quantile_bucket(F.col("n_below"), F.col("n_valid"), list(labels))
    ).drop("n_below", "n_valid")


def revenue_quartile(shipments: DataFrame) -> DataFrame:
    q = with_revenue_quartile(product_facts(shipments))
    return q.select(
        "product_id",
        F.col("_revenue").cast("double").alias("total_revenue"),
        "revenue_quartile",
    )


def stock_band(days: Column, bands=STOCK_BANDS, over: str = STOCK_BAND_OVER) -> Column:
    """Band label by days of stock. A NULL count falls through to ``over``,
    as a NaN comparison did in the original computation."""
    expr = None
    for limit, label in bands:
        cond = days <= F.lit(float(limit))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(over))


# --------------------------------------------------------------------------
# inventory table
# --------------------------------------------------------------------------
def inventory_build(
    shipments: DataFrame,
    days_of_stock: Column | DataFrame,
    bands=STOCK_BANDS,
    priority_band: str = PRIORITY_BAND,
    priority_quartile: str = PRIORITY_QUARTILE,
    order_key: str = "Order_Id",
) -> DataFrame:
    """One row per product with demand: mean daily demand, category, revenue
    quartile, days of stock, stock level = int(mean demand x days), band and
    the priority flag (priority band and top quartile). ``order_key`` decides
    a product's first category."""
    demand = avg_demand(shipments)
    # ranking refers to its input several times: one row per product, written once
    facts = materialise(
        shipments.sparkSession, product_facts(shipments, order_key=order_key), "product_facts"
    )
    facts = with_revenue_quartile(facts).select(
        "product_id", "category_name", "revenue_quartile"
    )
    inv = demand.join(facts, "product_id", "left")
    if isinstance(days_of_stock, DataFrame):
        inv = inv.join(days_of_stock.select("product_id", "days_of_stock"), "product_id", "left")
    else:
        inv = inv.withColumn("days_of_stock", days_of_stock.cast("double"))
    stock = (F.col("avg_daily_demand_30d") * F.col("days_of_stock")).cast("bigint")
    band = stock_band(F.col("days_of_stock"), bands)
    priority = F.coalesce(
        (band == F.lit(priority_band)) & (F.col("revenue_quartile") == F.lit(priority_quartile)),
        F.lit(False),
    )
    return inv.select(
        "product_id",
        "avg_daily_demand_30d",
        "category_name",
        "revenue_quartile",
        "days_of_stock",
        stock.alias("simulated_stock"),
        band.alias("stock_status"),
        priority.alias("priority_critical"),
    )


def stock_status_summary(
    inventory: DataFrame, bands=STOCK_BANDS, over: str = STOCK_BAND_OVER
) -> DataFrame:
    """Products per stock band and their share of all products. Every band
    is listed, with 0 when no product falls in it. The share uses a window
    over the band rows (as many as there are bands)."""
    labels = [label for _, label in bands] + [over]
    all_bands = inventory.sparkSession.createDataFrame(
        [(label,) for label in labels], "stock_status string"
    )
    counts = inventory.groupBy("stock_status").agg(F.count(F.lit(1)).alias("products"))
    rows = all_bands.join(counts, "stock_status", "left").select(
        "stock_status", F.coalesce(F.col("products"), F.lit(0)).cast("bigint").alias("products")
    )
    total = F.sum("products").over(Window.partitionBy())
    return rows.withColumn("pct", pct_of(F.col("products"), total))


def priority_critical_count(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count_if(F.col("priority_critical")).alias("priority_critical_products"))


def critical_products(inventory: DataFrame, max_days: float = 7.0) -> DataFrame:
    """One row: products with at most ``max_days`` of stock, and of those the
    priority ones."""
    crit = F.col("days_of_stock") <= F.lit(float(max_days))
    return inventory.agg(
        F.count_if(crit).alias("critical_products"),
        F.count_if(crit & F.col("priority_critical")).alias("priority_critical_products"),
        F.count(F.lit(1)).alias("products"),
    )


# --------------------------------------------------------------------------
# stock cover from rolling demand
# --------------------------------------------------------------------------
def rolling_demand(da: DataFrame, window: int = ROLLING_ROWS) -> DataFrame:
    """Mean daily units over the last ``window`` *rows* (active days) per
    product, current day included."""
    w = (
        Window.partitionBy("Product_Card_Id")
        .orderBy(F.col("order_day").asc_nulls_first())
        .rowsBetween(-(window - 1), Window.currentRow)
    )
    return daily_demand(da).withColumn(
        "rolling_avg_demand_30d", F.avg(F.col("daily_qty").cast("double")).over(w)
    )


def latest_rolling(da: DataFrame, window: int = ROLLING_ROWS) -> DataFrame:
    """The rolling mean on each product's latest day (a NULL day sorts last).

    That is the mean of the product's last ``window`` rows by day: the frame
    ``ROWS window-1 PRECEDING`` of the latest row. So it is computed as
    ``row_number <= window`` (which Spark turns into a group limit applied
    before the shuffle) and one aggregate, instead of a sliding mean for every
    day. The result equals taking ``rolling_demand`` at its latest row; the
    oracle computes it that way.
    """
    w = Window.partitionBy("Product_Card_Id").orderBy(F.col("order_day").desc_nulls_last())
    return (
        daily_demand(da)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= F.lit(window))
        .groupBy("Product_Card_Id")
        .agg(F.avg(F.col("daily_qty").cast("double")).alias("rolling_avg_demand_30d"))
    )


def inventory_health(
    inventory: DataFrame, da: DataFrame, window: int = ROLLING_ROWS
) -> DataFrame:
    """Inventory with cover recomputed as stock / latest rolling demand,
    rounded to 0.1 day; 999 when there is no demand."""
    lr = latest_rolling(da, window)
    j = inventory.join(lr, inventory.product_id == lr.Product_Card_Id, "left")
    latest = F.coalesce(F.col("rolling_avg_demand_30d"), F.lit(0.0))
    adjusted = F.when(
        latest > 0,
        round_half_up(F.col("simulated_stock").cast("double") / F.col("rolling_avg_demand_30d"), 1),
    ).otherwise(F.lit(NO_DEMAND_COVER))
    return j.select(
        "product_id",
        "category_name",
        "revenue_quartile",
        "avg_daily_demand_30d",
        "simulated_stock",
        "days_of_stock",
        "stock_status",
        "priority_critical",
        latest.alias("latest_rolling_demand"),
        adjusted.alias("adjusted_days_of_stock"),
    ).orderBy(F.col("days_of_stock").asc_nulls_first(), F.col("product_id").asc())
