"""Interquartile-range outliers.

Plan: ``percentile`` is an exact, interpolating quantile (the continuous
quantile, not ``percentile_approx``). Spark computes it as a partial
aggregate per task whose buffer holds one counter per *distinct* value, then
merges the buffers in one task. For ``delay_days`` the distinct values are a
few dozen small integers, so the buffer stays tiny whatever the row count.
The one-row bounds enter the row-level plan as a scalar subquery (one
struct, one small job), not as a join. The outlier test is then a plain filter
on the scan, so the shipments are scanned once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.constants import (
    ANOMALY_DIRECTIONS,
    ANOMALY_FLAGS,
    IQR_K_EXTREME,
    IQR_K_MILD,
    IQR_QUARTILES,
    RANGE_JOINER,
)
from freightlens.functions.columns import round_half_up
from freightlens.operators.selection import exact_quantiles

OUTLIER_COLUMNS = (
    "Order_Id",
    "route_segment",
    "Shipping_Mode",
    "Market",
    "Order_Region",
    "Category_Name",
    "delay_days",
    "Sales",
    "Order_Profit_Per_Order",
)


def iqr_bounds(
    df: DataFrame,
    col: str = "delay_days",
    k_mild: float = IQR_K_MILD,
    k_extreme: float = IQR_K_EXTREME,
    method: str | None = None,
) -> DataFrame:
    """One row: Q1, Q3, IQR and the mild and extreme fences (unrounded).

    ``method="percentile"`` uses Spark's exact ``percentile``: its buffer
    holds one counter per distinct value, fine for day counts.
    ``method="distributed"`` selects the same quantiles digit by digit
    (``selection.exact_quantiles``): no value is sorted or shuffled; its passes
    run when the operator is called. By default the column's type decides: whole
    numbers of 32 bits or fewer, as day counts are, go the first way and all
    others the second.
    """
    if method is None:
        small = isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType))
        method = "percentile" if small else "distributed"
    if method == "distributed":
        q = exact_quantiles(df, col, {"_q1": IQR_QUARTILES[0], "_q3": IQR_QUARTILES[1]})
        q1, q3 = F.col("_q1"), F.col("_q3")
    elif method == "percentile":
        probs = F.array(*[F.lit(p) for p in IQR_QUARTILES])
        q = df.agg(F.percentile(F.col(col), probs).alias("_q"))
        q1, q3 = F.col("_q")[0], F.col("_q")[1]
    else:
        raise ValueError(f"unknown method {method!r}")
    iqr = q3 - q1
    return q.select(
        q1.alias("Q1"),
        q3.alias("Q3"),
        iqr.alias("IQR"),
        (q1 - F.lit(float(k_mild)) * iqr).alias("lower_bound_mild"),
        (q3 + F.lit(float(k_mild)) * iqr).alias("upper_bound_mild"),
        (q1 - F.lit(float(k_extreme)) * iqr).alias("lower_bound_extreme"),
        (q3 + F.lit(float(k_extreme)) * iqr).alias("upper_bound_extreme"),
    )


def bound_values(
    df: DataFrame,
    col: str = "delay_days",
    k_mild: float = IQR_K_MILD,
    k_extreme: float = IQR_K_EXTREME,
    method: str | None = None,
) -> dict[str, Column]:
    """The ``iqr_bounds`` row as scalar-subquery column expressions."""
    b = iqr_bounds(df, col, k_mild, k_extreme, method)
    packed = b.select(F.struct(*b.columns).alias("b")).scalar()
    return {c: packed[c] for c in b.columns}


def _flagged(df: DataFrame, col: str, k_mild: float, k_extreme: float, only_outliers: bool):
    bv = bound_values(df, col, k_mild, k_extreme)
    v = F.col(col)
    lo, hi = bv["lower_bound_mild"], bv["upper_bound_mild"]
    # A strict test: a value equal to a fence is not an outlier.
    rows = df.where((v < lo) | (v > hi)) if only_outliers else df
    flag = (
        F.when((v < bv["lower_bound_extreme"]) | (v > bv["upper_bound_extreme"]), ANOMALY_FLAGS[0])
        .when((v < lo) | (v > hi), ANOMALY_FLAGS[1])
        .otherwise(ANOMALY_FLAGS[2])
    )
    direction = (
        F.when(v > hi, ANOMALY_DIRECTIONS[0])
        .when(v < lo, ANOMALY_DIRECTIONS[1])
        .otherwise(ANOMALY_DIRECTIONS[2])
    )
    expected_range = F.concat(
        F.coalesce(round_half_up(lo, 0).cast("int").cast("string"), F.lit("")),
        F.lit(RANGE_JOINER),
        F.coalesce(round_half_up(hi, 0).cast("int").cast("string"), F.lit("")),
    )
    cols = list(OUTLIER_COLUMNS) + ([col] if col not in OUTLIER_COLUMNS else [])
    return rows.select(
        *cols,
        round_half_up(bv["Q1"], 2).alias("Q1"),
        round_half_up(bv["Q3"], 2).alias("Q3"),
        round_half_up(bv["IQR"], 2).alias("IQR"),
        round_half_up(lo, 2).alias("lower_bound"),
        round_half_up(hi, 2).alias("upper_bound"),
        expected_range.alias("expected_range"),
        flag.alias("anomaly_flag"),
        direction.alias("anomaly_direction"),
        F.abs(v - (bv["Q1"] + bv["Q3"]) / 2).alias("_distance"),
    )


def iqr_anomalies(
    da: DataFrame, col: str = "delay_days", k_mild: float = IQR_K_MILD, k_extreme: float = IQR_K_EXTREME
) -> DataFrame:
    """Rows outside the mild fences, with the fences, a flag (Extreme /
    Outlier) and a direction, farthest from the quartile midpoint first."""
    out = _flagged(da, col, k_mild, k_extreme, only_outliers=True)
    return out.orderBy(F.col("_distance").desc(), F.col("Order_Id").asc()).drop("_distance")


def iqr_flag_all(
    da: DataFrame, col: str = "delay_days", k_mild: float = IQR_K_MILD, k_extreme: float = IQR_K_EXTREME
) -> DataFrame:
    """Every row with its flag, including Normal / Within Range (unsorted)."""
    return _flagged(da, col, k_mild, k_extreme, only_outliers=False).drop("_distance")


def anomaly_share(da: DataFrame, col: str = "delay_days", k_mild: float = IQR_K_MILD) -> DataFrame:
    """One row: outliers, all rows, and the outlier share in percent."""
    bv = bound_values(da, col, k_mild)
    v = F.col(col)
    is_out = (v < bv["lower_bound_mild"]) | (v > bv["upper_bound_mild"])
    n_out = F.count_if(is_out)
    n = F.count(F.lit(1))
    return da.agg(
        n_out.alias("outlier_orders"),
        n.alias("total_orders"),
        (n_out.cast("double") * F.lit(100.0) / F.nullif(n, F.lit(0))).alias("outlier_pct"),
    )
