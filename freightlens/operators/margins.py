"""Margin erosion, the route lookup and headline KPIs.

All of these are one aggregate on a few low-cardinality keys: partial
aggregation per task, one hash exchange, final aggregate. The KPIs
aggregate the already-aggregated group rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.constants import COST_FLAGS, EROSION_COST_LIMIT, EROSION_MIN_ORDERS, PROFIT_FLAGS
from freightlens.functions.columns import pct_of, round_half_up
from freightlens.functions.exact import exact_mean_of, exact_sum_of, grouped

EROSION_KEYS = ("Market", "Order_Region", "Shipping_Mode", "Category_Name")


def _ratio_pct(num, den):
    """``num * 100 / den`` on double values of two exact sums; NULL if den is 0."""
    return num.cast("double") * F.lit(100.0) / F.nullif(den.cast("double"), F.lit(0.0))


def cost_erosion(
    da: DataFrame,
    min_n: int = EROSION_MIN_ORDERS,
    cost_limit: float = EROSION_COST_LIMIT,
    keys: Sequence[str] = EROSION_KEYS,
) -> DataFrame:
    """Per (market, region, mode, category) with at least ``min_n`` orders:
    revenue, profit, implied cost, cost and margin share of revenue, mean
    discount, a cost flag (cost share above ``cost_limit``) and a
    profitability flag. A group with no revenue has a NULL share and is
    'Normal'."""
    agg = grouped(
        da,
        keys,
        {
            "total_orders": F.count(F.lit(1)),
            "_sales": exact_sum_of("Sales"),
            "_profit": exact_sum_of("Order_Profit_Per_Order"),
            "_cost": exact_sum_of("implied_total_cost"),
            "_disc": exact_mean_of("Order_Item_Discount_Rate"),
        },
    ).where(F.col("total_orders") >= F.lit(min_n))
    cost_pct = _ratio_pct(F.col("_cost"), F.col("_sales"))
    margin_pct = _ratio_pct(F.col("_profit"), F.col("_sales"))
    return agg.select(
        *keys,
        "total_orders",
        F.round("_sales", 2).cast("double").alias("total_revenue"),
        F.round("_profit", 2).cast("double").alias("total_profit"),
        F.round("_cost", 2).cast("double").alias("total_implied_cost"),
        round_half_up(cost_pct, 2).alias("cost_pct_revenue"),
        round_half_up(margin_pct, 2).alias("profit_margin_pct"),
        round_half_up(F.col("_disc") * F.lit(100.0), 2).alias("avg_discount_pct"),
        F.when(cost_pct > F.lit(float(cost_limit)), COST_FLAGS[0])
        .otherwise(COST_FLAGS[1])
        .alias("cost_flag"),
        F.when(F.col("_profit") < 0, PROFIT_FLAGS[0])
        .otherwise(PROFIT_FLAGS[1])
        .alias("profitability_flag"),
    ).orderBy(F.col("profit_margin_pct").asc_nulls_first(), *[F.col(k).asc() for k in keys])


def route_lookup(shipments: DataFrame) -> DataFrame:
    """Per route segment (NULL segments left out): shipments (non-NULL order
    ids), mean delay, count of the source late-risk flag, mean sales and
    profit, and on-time rate = (1 - late / shipments) * 100."""
    seg = shipments.where(F.col("route_segment").isNotNull())
    agg = grouped(
        seg,
        ["route_segment"],
        {
            "total_shipments": F.count("Order_Id"),
            "avg_delay": exact_mean_of("delay_days"),
            "late_count": F.coalesce(F.sum("Late_delivery_risk"), F.lit(0)).cast("bigint"),
            "avg_sales": exact_mean_of("Sales"),
            "avg_profit": exact_mean_of("Order_Profit_Per_Order"),
        },
    )
    on_time = (
        F.lit(1.0)
        - F.col("late_count").cast("double") / F.nullif(F.col("total_shipments"), F.lit(0))
    ) * F.lit(100.0)
    return agg.withColumn("on_time_rate", on_time)


def kpi_on_time_by_mode(da: DataFrame, group: str = "Shipping_Mode") -> DataFrame:
    """On-time rate per shipping mode, late meaning ``delay_days > 0``."""
    n = F.count(F.lit(1))
    late = F.count_if(F.col("delay_days") > 0)
    return da.groupBy(group).agg(
        n.alias("shipments"),
        late.alias("late_shipments"),
        round_half_up(F.lit(100.0) - pct_of(late, n), 2).alias("on_time_rate_pct"),
    )


def kpi_cost_share(erosion: DataFrame) -> DataFrame:
    """One row over ``cost_erosion`` groups: how many, how many over the cost
    limit and their share, how many unprofitable."""
    n = F.count(F.lit(1))
    high = F.count_if(F.col("cost_flag") == COST_FLAGS[0])
    return erosion.agg(
        n.alias("route_groups"),
        high.alias("high_cost_groups"),
        pct_of(high, n).alias("high_cost_share_pct"),
        F.count_if(F.col("profitability_flag") == PROFIT_FLAGS[0]).alias("unprofitable_groups"),
    )
