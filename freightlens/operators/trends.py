"""Daily statistics per shipping mode and their 30-row rolling means.

Plan: one aggregate on (day, mode), then a window partitioned by mode. The
window sees one row per (day, mode), so a mode has at most one row per
calendar day whatever its order volume, and the three rolling means share
one window spec (one sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightlens.constants import ROLLING_ROWS
from freightlens.functions.columns import exact_mean, pct_of, round_half_up


def daily_stats(da: DataFrame, group: str = "Shipping_Mode") -> DataFrame:
    """Per (day, mode): orders, mean delay, mean implied cost and on-time
    share (on time means ``delay_days <= 0``)."""
    n = F.count(F.lit(1))
    on_time = F.sum(F.when(F.col("delay_days") <= 0, 1).otherwise(0))
    return da.groupBy(F.to_date("order_date").alias("order_day"), F.col(group)).agg(
        n.alias("daily_orders"),
        exact_mean("delay_days").alias("daily_avg_delay"),
        exact_mean("implied_total_cost").alias("daily_avg_cost"),
        pct_of(on_time, n).alias("daily_on_time_pct"),
    )


def rolling_trends(
    da: DataFrame, window: int = ROLLING_ROWS, group: str = "Shipping_Mode"
) -> DataFrame:
    """Rolling means over the last ``window`` rows (active days) per mode.

    Each is a mean of daily means, so a day counts once however many orders
    it had.
    """
    w = (
        Window.partitionBy(group)
        .orderBy(F.col("order_day").asc_nulls_first())
        .rowsBetween(-(window - 1), Window.currentRow)
    )
    d = daily_stats(da, group)
    return d.select(
        "order_day",
        group,
        "daily_orders",
        round_half_up(F.avg("daily_avg_delay").over(w), 2).alias("rolling_30d_avg_delay"),
        round_half_up(F.avg("daily_avg_cost").over(w), 2).alias("rolling_30d_avg_cost"),
        round_half_up(F.avg("daily_on_time_pct").over(w), 2).alias("rolling_30d_on_time_pct"),
    ).orderBy(F.col(group).asc_nulls_first(), F.col("order_day").asc_nulls_first())
