"""Query catalog: every operator as ``(spark, sf_dir) -> DataFrame``.

Each entry reads the test tables in ``sf_dir`` (directly, or through the
cleaned shipments table Spark derives from them) and runs over all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.functions.columns import round_half_up
from freightlens.operators import clean, inventory as inv, margins, outliers, scoring, trends, views
from freightlens.operators.sinks import write_csv_quoted
from freightlens.plans import tables as P
from freightlens.plans.session import checkpoint_dir, shuffles_removed
from freightlens.sources.files import FILE_ORDER_KEY, read_raw_order_lines_csv
from freightlens.sources.tpch import LINE_SORT_KEY

EXPORT_LINES = 1 << 19  # of a compressed file of the raw export, some 120 MB of text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Report money and rates as doubles. Inside the library they are exact
    decimals (so sums do not depend on row order); a reported value is the
    nearest double to the exact one."""
    casts = {
        f.name: F.col(f"`{f.name}`").cast("double")
        for f in df.schema.fields
        if isinstance(f.dataType, T.DecimalType)
    }
    return df.withColumns(casts) if casts else df


def query(name: str):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return decimals_as_double(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


# -- sources ---------------------------------------------------------------
@query("shipments")
def q_shipments(spark, sf):
    return P.shipments(spark, sf)


def raw_lines_by_order(spark, sf):
    """The raw lines with the lines of an order one after the other. Sort-merge
    joins leave them dealt by the order key; then they are not shuffled again."""
    lines = P.raw_lines(spark, sf)
    return lines.repartition("Order Id").sortWithinPartitions("Order Id", LINE_SORT_KEY)


@query("raw_csv_roundtrip")
def q_raw_csv_roundtrip(spark, sf):
    """All raw lines as a quoted CSV export with its columns in another order,
    read back by header name and cleaned."""
    ordered = raw_lines_by_order(spark, sf)
    columns = sorted(c for c in ordered.columns if c != LINE_SORT_KEY)
    path = f"{checkpoint_dir(spark)}/tables/raw-export-{uuid.uuid4().hex}"
    # Plain, the text is about ten times the tables it was joined from.
    with shuffles_removed(spark):
        write_csv_quoted(ordered.select([f"`{c}`" for c in columns]), path, compression="lz4", max_lines=EXPORT_LINES)
        wanted = P.shipments(spark, sf).columns
    raw = read_raw_order_lines_csv(spark, path, encoding="UTF-8")
    ships = clean.clean_shipments(raw, order_by=[FILE_ORDER_KEY], drop=[FILE_ORDER_KEY])
    return ships.select(wanted)


@query("delivery_analysis")
def q_delivery_analysis(spark, sf):
    return P.view(spark, sf)


# -- cleaning (raw lines) --------------------------------------------------
@query("parse_dates")
def q_parse_dates(spark, sf):
    df = P.raw_lines_parsed(spark, sf)
    return df.select(
        F.col("`Order Id`").alias("Order_Id"),
        F.col("`order date (DateOrders)`").alias("order_date_text"),
        F.col("`shipping date (DateOrders)`").alias("shipping_date_text"),
        "order_date",
        "shipping_date",
    )


@query("null_date_count")
def q_null_date_count(spark, sf):
    return clean.null_date_count(P.raw_lines_parsed(spark, sf))


@query("dedup_orders")
def q_dedup_orders(spark, sf):
    return clean.sql_friendly_columns(P.first_order_lines(spark, sf).drop(LINE_SORT_KEY))


@query("dedup_stats")
def q_dedup_stats(spark, sf):
    return clean.dedup_stats(P.raw_lines(spark, sf), "Order Id")


# -- cleaning (one row per order) ------------------------------------------
@query("derive_delivery")
def q_derive_delivery(spark, sf):
    return P.shipments(spark, sf).select(
        "Order_Id", "order_date", "actual_delivery_date", "scheduled_delivery_date",
        "delay_days", "calculated_status",
    )


@query("status_match")
def q_status_match(spark, sf):
    return clean.status_match(P.shipments(spark, sf), source_col="Delivery_Status")


@query("route_segment")
def q_route_segment(spark, sf):
    return P.shipments(spark, sf).select("Order_Id", "route_segment")


@query("segment_count")
def q_segment_count(spark, sf):
    return clean.segment_count(P.shipments(spark, sf))


@query("segment_top5")
def q_segment_top5(spark, sf):
    return clean.segment_top(P.shipments(spark, sf), 5)


@query("cost_metrics")
def q_cost_metrics(spark, sf):
    return P.shipments(spark, sf).select(
        "Order_Id", "Sales", "Order_Profit_Per_Order", "implied_total_cost", "cost_pct_revenue"
    )


@query("negative_profit_share")
def q_negative_profit_share(spark, sf):
    return clean.negative_profit_share(P.shipments(spark, sf), profit="Order_Profit_Per_Order")


# -- view checks -----------------------------------------------------------
@query("row_count")
def q_row_count(spark, sf):
    return views.row_count(P.view(spark, sf))


@query("status_breakdown")
def q_status_breakdown(spark, sf):
    return views.status_breakdown(P.view(spark, sf))


@query("status_crosstab")
def q_status_crosstab(spark, sf):
    return views.status_crosstab(P.view(spark, sf))


# -- scorecards ------------------------------------------------------------
@query("segment_metrics")
def q_segment_metrics(spark, sf):
    return scoring.segment_metrics(P.view(spark, sf))


@query("segment_scorecard")
def q_segment_scorecard(spark, sf):
    return scoring.segment_scorecard(P.view(spark, sf))


@query("corridor_metrics")
def q_corridor_metrics(spark, sf):
    # compared to nine digits: a plain standard deviation differs in the last
    metrics = scoring.corridor_metrics(P.view(spark, sf))
    return metrics.withColumn("profit_volatility", round_half_up("profit_volatility", 9))


@query("corridor_risk")
def q_corridor_risk(spark, sf):
    return scoring.corridor_risk(P.view(spark, sf))


# -- outliers --------------------------------------------------------------
@query("iqr_bounds")
def q_iqr_bounds(spark, sf):
    return outliers.iqr_bounds(P.view(spark, sf))


@query("iqr_anomalies")
def q_iqr_anomalies(spark, sf):
    return outliers.iqr_anomalies(P.view(spark, sf))


@query("iqr_bounds_sales")
def q_iqr_bounds_sales(spark, sf):
    return outliers.iqr_bounds(P.view(spark, sf), col="Sales")


@query("iqr_anomalies_sales")
def q_iqr_anomalies_sales(spark, sf):
    return outliers.iqr_anomalies(P.view(spark, sf), col="Sales")


@query("iqr_flag_all")
def q_iqr_flag_all(spark, sf):
    return outliers.iqr_flag_all(P.view(spark, sf))


# -- margins ---------------------------------------------------------------
@query("cost_erosion")
def q_cost_erosion(spark, sf):
    return margins.cost_erosion(P.view(spark, sf))


@query("route_lookup")
def q_route_lookup(spark, sf):
    return margins.route_lookup(P.shipments(spark, sf))


# -- trends ----------------------------------------------------------------
@query("daily_stats")
def q_daily_stats(spark, sf):
    return trends.daily_stats(P.view(spark, sf))


@query("rolling_trends")
def q_rolling_trends(spark, sf):
    return trends.rolling_trends(P.view(spark, sf))


# -- inventory -------------------------------------------------------------
@query("daily_demand")
def q_daily_demand(spark, sf):
    return inv.daily_demand(P.view(spark, sf))


@query("rolling_demand")
def q_rolling_demand(spark, sf):
    return inv.rolling_demand(P.view(spark, sf))


@query("latest_rolling")
def q_latest_rolling(spark, sf):
    return inv.latest_rolling(P.view(spark, sf))


@query("avg_demand")
def q_avg_demand(spark, sf):
    return inv.avg_demand(P.shipments(spark, sf))


@query("product_category")
def q_product_category(spark, sf):
    return inv.product_category(P.shipments(spark, sf))


@query("product_revenue")
def q_product_revenue(spark, sf):
    return inv.product_revenue(P.shipments(spark, sf))


@query("revenue_quartile")
def q_revenue_quartile(spark, sf):
    return inv.revenue_quartile(P.shipments(spark, sf))


@query("inventory_build")
def q_inventory_build(spark, sf):
    return P.inventory_lazy(spark, sf)


@query("inventory_health")
def q_inventory_health(spark, sf):
    return inv.inventory_health(P.inventory(spark, sf), P.view(spark, sf))


@query("stock_status_summary")
def q_stock_status_summary(spark, sf):
    return inv.stock_status_summary(P.inventory(spark, sf))


@query("priority_critical_count")
def q_priority_critical_count(spark, sf):
    return inv.priority_critical_count(P.inventory(spark, sf))


# -- headline KPIs ---------------------------------------------------------
@query("kpi_on_time_by_mode")
def q_kpi_on_time_by_mode(spark, sf):
    return margins.kpi_on_time_by_mode(P.view(spark, sf))


@query("kpi_cost_share")
def q_kpi_cost_share(spark, sf):
    return margins.kpi_cost_share(margins.cost_erosion(P.view(spark, sf)))


@query("kpi_anomaly_share")
def q_kpi_anomaly_share(spark, sf):
    return outliers.anomaly_share(P.view(spark, sf))


@query("kpi_critical_products")
def q_kpi_critical_products(spark, sf):
    return inv.critical_products(P.inventory(spark, sf))
