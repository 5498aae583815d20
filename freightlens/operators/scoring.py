"""Percent-rank composite scores: route scorecard and corridor risk.

Both follow one shape: aggregate shipments per group, drop small groups,
turn each metric into a 0-1 ``percent_rank``, weight and sum to a 0-100
score, and label it by thresholds on the *unrounded* score.

Plan: partial aggregate -> one hash exchange on the group keys -> final
aggregate -> HAVING filter -> the groups, written as a small table -> ranks.
The written groups are counted: up to ``ONE_TASK_ROWS`` of them are ranked by
windows in one task, more by ``ranking.ranks_below``, which counts all ranks of
a score in one pass and puts nothing whole into one task. The HAVING filter must
stay below the ranks (it changes them).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.constants import (
    CANCEL_STATUSES,
    RECOMMENDATION_LIMITS,
    RECOMMENDATIONS,
    RISK_LABELS,
    RISK_MIN_ORDERS,
    RISK_TIERS,
    RISK_WEIGHTS,
    SCORECARD_LABELS,
    SCORECARD_MIN_SHIPMENTS,
    SCORECARD_TIERS,
    SCORECARD_WEIGHTS,
)
from freightlens.functions.columns import pct_of, round_half_up
from freightlens.functions.exact import exact_mean_of, exact_stddev_of, exact_sum_of, grouped
from freightlens.operators.ranking import ranks_below
from freightlens.plans.session import materialise

# Groups that one task may rank, about 200 bytes each.
ONE_TASK_ROWS = 100_000
SEGMENT_KEYS = ("route_segment", "Shipping_Mode", "Market", "Order_Region")


@dataclass(frozen=True)
class RankComponent:
    """One weighted input of a composite score.

    ``invert`` scores low values high (``1 - percent_rank``). That is not the
    same as ranking descending when there are ties.
    """

    name: str
    value: Column
    weight: float
    invert: bool = False


def weighted_percent_rank(
    df: DataFrame,
    components: Sequence[RankComponent],
    score_col: str,
    one_task_rows: int | None = None,
) -> DataFrame:
    """Add one ``percent_rank`` column per component and the weighted score
    ``(sum of rank * weight) * 100`` as ``score_col`` (unrounded).

    ``percent_rank`` (ascending, NULLs first) is the number of rows before a
    row's value over the number of other rows; a non-NULL value also has all
    NULL rows before it. Values are compared as doubles. ``df`` is written to
    the shared folder and counted there when this is called; the count decides
    how the ranks are found (see the module), never what they are.
    """
    df = materialise(df.sparkSession, df, "rank-input")
    values = {c.name: c.value.cast("double") for c in components}
    if df.count() <= (ONE_TASK_ROWS if one_task_rows is None else one_task_rows):
        order = {name: Window.orderBy(v.asc_nulls_first()) for name, v in values.items()}
        out = df.withColumns({name: F.percent_rank().over(w) for name, w in order.items()})
    else:
        nulls = [F.count_if(v.isNull()).alias(name) for name, v in values.items()]
        totals = df.select(F.struct(F.count(F.lit(1)).alias("_n"), *nulls).alias("t")).scalar()
        others = F.nullif(totals["_n"] - F.lit(1), F.lit(0)).cast("double")
        out = ranks_below(df, values)
        before = {name: F.coalesce(F.col(name) + totals[name], F.lit(0)) for name in values}
        out = out.withColumns({name: F.coalesce(n / others, F.lit(0.0)) for name, n in before.items()})
    score: Column | None = None
    for comp in components:
        if comp.invert:
            out = out.withColumn(comp.name, F.lit(1) - F.col(comp.name))
        term = F.col(comp.name) * F.lit(float(comp.weight))
        score = term if score is None else score + term
    return out.withColumn(score_col, score * F.lit(100.0))


def _tier(score: Column, cuts: Sequence[tuple[float, str]], default: str) -> Column:
    expr = None
    for cut, label in cuts:
        cond = score >= F.lit(float(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


# --------------------------------------------------------------------------
# route segment scorecard
# --------------------------------------------------------------------------
def segment_metrics(
    da: DataFrame, min_n: int = SCORECARD_MIN_SHIPMENTS, keys: Sequence[str] = SEGMENT_KEYS
) -> DataFrame:
    """Per segment: volume, mean delay, late and on-time share (late means
    ``delay_days > 0``), mean cost and profit, revenue. Groups under
    ``min_n`` shipments are dropped."""
    late = F.sum(F.when(F.col("delay_days") > 0, 1).otherwise(0))
    n = F.count(F.lit(1))
    metrics = grouped(
        da,
        keys,
        {
            "total_shipments": n,
            "avg_delay_days": exact_mean_of("delay_days"),
            "late_rate_pct": pct_of(late, n),
            "on_time_rate_pct": F.lit(100.0) - pct_of(late, n),
            "avg_implied_cost": exact_mean_of("implied_total_cost"),
            "avg_profit": exact_mean_of("Order_Profit_Per_Order"),
            "total_revenue": exact_sum_of("Sales"),
        },
    )
    metrics = metrics.where(F.col("total_shipments") >= F.lit(min_n))
    return metrics.withColumn("total_revenue", F.col("total_revenue").cast("double"))


def segment_scorecard(
    da: DataFrame,
    min_n: int = SCORECARD_MIN_SHIPMENTS,
    weights: Sequence[float] = SCORECARD_WEIGHTS,
    tiers: Sequence[float] = SCORECARD_TIERS,
) -> DataFrame:
    """Reliability score 0-100 per route segment and a tier.

    Weights are (on-time share, low delay, low cost, volume). Tier:
    ``>= tiers[0]`` Preferred, ``>= tiers[1]`` Acceptable, else Under Review,
    tested on the unrounded score.
    """
    w_on_time, w_delay, w_cost, w_volume = weights
    m = segment_metrics(da, min_n)
    ranked = weighted_percent_rank(
        m,
        [
            RankComponent("norm_on_time", F.col("on_time_rate_pct"), w_on_time),
            RankComponent("norm_delay_penalty", F.col("avg_delay_days"), w_delay, invert=True),
            RankComponent("norm_cost_efficiency", F.col("avg_implied_cost"), w_cost, invert=True),
            RankComponent("norm_volume", F.col("total_shipments"), w_volume),
        ],
        "_score",
    )
    score = F.col("_score")
    return ranked.select(
        *SEGMENT_KEYS,
        "total_shipments",
        round_half_up("on_time_rate_pct", 2).alias("on_time_rate_pct"),
        round_half_up("avg_delay_days", 2).alias("avg_delay_days"),
        round_half_up("avg_implied_cost", 2).alias("avg_implied_cost"),
        round_half_up("avg_profit", 2).alias("avg_profit"),
        round_half_up("total_revenue", 2).alias("total_revenue"),
        round_half_up(score, 2).alias("reliability_score"),
        _tier(score, list(zip(tiers, SCORECARD_LABELS)), SCORECARD_LABELS[-1]).alias("tier"),
    ).orderBy(F.col("reliability_score").desc(), F.col("route_segment").asc())


# --------------------------------------------------------------------------
# corridor risk
# --------------------------------------------------------------------------
def corridor_metrics(
    da: DataFrame,
    min_n: int = RISK_MIN_ORDERS,
    cancel_statuses: Sequence[str] = CANCEL_STATUSES,
    keys: Sequence[str] = SEGMENT_KEYS,
) -> DataFrame:
    """Per corridor: cancellation/fraud share, late share by the source risk
    flag, mean discount, profit-ratio volatility (sample standard deviation),
    revenue and count of loss-making orders."""
    n = F.count(F.lit(1))
    cancels = F.sum(F.when(F.col("Order_Status").isin(*cancel_statuses), 1).otherwise(0))
    losses = F.sum(F.when(F.col("Order_Profit_Per_Order") < 0, 1).otherwise(0))
    metrics = grouped(
        da,
        keys,
        {
            "total_orders": n,
            "cancel_fraud_rate": pct_of(cancels, n),
            "late_delivery_rate": exact_mean_of("Late_delivery_risk"),
            "avg_discount_pct": exact_mean_of("Order_Item_Discount_Rate"),
            "profit_volatility": exact_stddev_of("Order_Item_Profit_Ratio"),
            "total_revenue": exact_sum_of("Sales"),
            "negative_profit_orders": losses.cast("bigint"),
        },
    )
    return metrics.where(F.col("total_orders") >= F.lit(min_n)).withColumns(
        {
            "late_delivery_rate": F.col("late_delivery_rate") * F.lit(100.0),
            "avg_discount_pct": F.col("avg_discount_pct") * F.lit(100.0),
            "total_revenue": F.col("total_revenue").cast("double"),
        }
    )


def corridor_risk(
    da: DataFrame,
    min_n: int = RISK_MIN_ORDERS,
    weights: Sequence[float] = RISK_WEIGHTS,
    tiers: Sequence[float] = RISK_TIERS,
    cancel_statuses: Sequence[str] = CANCEL_STATUSES,
    limits: Sequence[float] = RECOMMENDATION_LIMITS,
) -> DataFrame:
    """Risk score 0-100 per corridor, a tier and one recommendation.

    Weights are (cancel/fraud, late, discount, volatility); a missing
    volatility (one-order group) counts as 0. ``limits`` are (cancel/fraud %,
    discount %, late %, volatility). The recommendation is the first limit
    exceeded, in that order, tested on unrounded values; otherwise 'Monitor'.
    """
    w_cancel, w_late, w_disc, w_vol = weights
    cancel_limit, discount_limit, late_limit, volatility_limit = limits
    m = corridor_metrics(da, min_n, cancel_statuses)
    vol = F.coalesce(F.col("profit_volatility"), F.lit(0.0))
    ranked = weighted_percent_rank(
        m,
        [
            RankComponent("norm_cancel_risk", F.col("cancel_fraud_rate"), w_cancel),
            RankComponent("norm_late_risk", F.col("late_delivery_rate"), w_late),
            RankComponent("norm_discount_risk", F.col("avg_discount_pct"), w_disc),
            RankComponent("norm_volatility_risk", vol, w_vol),
        ],
        "_score",
    )
    score = F.col("_score")
    recommendation = (
        F.when(F.col("cancel_fraud_rate") > F.lit(float(cancel_limit)), RECOMMENDATIONS[0])
        .when(F.col("avg_discount_pct") > F.lit(float(discount_limit)), RECOMMENDATIONS[1])
        .when(F.col("late_delivery_rate") > F.lit(float(late_limit)), RECOMMENDATIONS[2])
        .when(vol > F.lit(float(volatility_limit)), RECOMMENDATIONS[3])
        .otherwise(RECOMMENDATIONS[4])
    )
    return ranked.select(
        *SEGMENT_KEYS,
        "total_orders",
        round_half_up("cancel_fraud_rate", 2).alias("cancel_fraud_rate_pct"),
        round_half_up("late_delivery_rate", 2).alias("late_delivery_rate_pct"),
        round_half_up("avg_discount_pct", 2).alias("avg_discount_pct"),
        round_half_up(vol, 4).alias("profit_volatility"),
        round_half_up("total_revenue", 2).alias("total_revenue"),
        round_half_up(score, 2).alias("risk_score"),
        _tier(score, list(zip(tiers, RISK_LABELS)), RISK_LABELS[-1]).alias("risk_tier"),
        recommendation.alias("recommendation"),
    ).orderBy(F.col("risk_score").desc(), F.col("route_segment").asc())
