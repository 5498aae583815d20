"""Cleaning and feature columns: raw order lines -> one shipment per order.

Steps, in the order the cleaning runs them:

1. ``parse_dates``        text dates -> ``timestamp_ntz``; bad text -> NULL
2. ``dedup_first``        keep the first line of every order
3. ``derive_delivery``    delivery dates, ``delay_days``, status
4. ``add_route_segment``  mode > market > region label
5. ``add_cost_metrics``   implied cost and cost share of revenue
6. ``sql_friendly_columns`` export-friendly names

``clean_shipments`` chains them. The counters the cleaning reports
(NULL dates, duplicates removed, status agreement, segment count and top
five, negative-profit share) are separate one-row operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.constants import (
    ROUTE_MAX_LENGTH,
    ROUTE_SEPARATOR,
    STATUS_EARLY,
    STATUS_LATE,
    STATUS_ON_TIME,
    TOP_SEGMENTS,
)
from freightlens.functions.columns import (
    add_days,
    parse_timestamp,
    pct_of,
    sql_friendly_name,
    strip_py,
)
from freightlens.sources.schemas import RAW_DATE_FORMAT

RAW_DATE_COLUMNS = {
    "order_date": "order date (DateOrders)",
    "shipping_date": "shipping date (DateOrders)",
}


# --------------------------------------------------------------------------
# 1. dates
# --------------------------------------------------------------------------
def parse_dates(
    df: DataFrame,
    columns: dict[str, str] | None = None,
    fmt: str = RAW_DATE_FORMAT,
) -> DataFrame:
    """Add parsed timestamp columns ``{new_name: source_text_column}``."""
    columns = RAW_DATE_COLUMNS if columns is None else columns
    return df.withColumns({new: parse_timestamp(src, fmt) for new, src in columns.items()})


def null_date_count(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """One row: how many rows have no (parseable) date."""
    return df.agg(F.count_if(F.col(date_col).isNull()).alias("null_order_dates"))


# --------------------------------------------------------------------------
# 2. first line per key
# --------------------------------------------------------------------------
def dedup_first(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    also: Sequence[Column] = (),
) -> DataFrame:
    """Keep one row per ``keys``: the one that is smallest by ``order_by``.

    Written as an aggregate, ``min(struct(order..., row))``, not as a
    ``row_number`` window: the aggregate combines map-side before the shuffle,
    so a key that owns a large share of the lines is reduced to one row per
    task instead of being sorted in a single task. Ties on ``order_by`` are
    broken by the remaining columns, so the survivor is fully determined
    (``dropDuplicates`` keeps an arbitrary row). NULL keys form one group.
    Order columns given by name are carried once, in the order part of the
    struct, not again in the row part. ``also`` adds aggregates over all rows
    of the key.
    """
    keys = list(keys)
    order_names = {c: i for i, c in enumerate(order_by) if isinstance(c, str)}
    rest = [c for c in df.columns if c not in keys and c not in order_names]
    order_fields = [
        (F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"_o{i}")
        for i, c in enumerate(order_by)
    ]
    packed = F.struct(*order_fields, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    first = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(packed).alias("_first"), *also)

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(f"`{c}`")
        if c in order_names:
            return F.col(f"_first._o{order_names[c]}").alias(c)
        return F.col(f"_first.row.`{c}`").alias(c)

    added = [c for c in first.columns if c not in keys and c != "_first"]
    return first.select(*[pick(c) for c in df.columns], *added)


def dedup_stats(df: DataFrame, key: str = "Order Id") -> DataFrame:
    """One row: rows before, rows after keeping one per key, rows removed.

    All NULL keys count as one key, as they survive as one row.
    """
    k = F.col(f"`{key}`")
    before = F.count(F.lit(1))
    after = F.count_distinct(k) + F.max(F.when(k.isNull(), 1).otherwise(0))
    return df.agg(
        before.alias("rows_before"),
        after.cast("bigint").alias("rows_after"),
        (before - after).cast("bigint").alias("rows_removed"),
    )


# --------------------------------------------------------------------------
# 3. delivery features
# --------------------------------------------------------------------------
def derive_delivery(
    df: DataFrame,
    order_date: str = "order_date",
    real_days: str = "Days for shipping (real)",
    scheduled_days: str = "Days for shipment (scheduled)",
) -> DataFrame:
    """Actual and scheduled delivery dates, ``delay_days`` (positive = late)
    and ``calculated_status``.

    ``calculated_status`` is 'On Time' when the delay is NULL: the original
    computation compared NaN, which is false both ways. The shared view
    recomputes a status that is NULL in that case.
    """
    real = F.col(f"`{real_days}`")
    sched = F.col(f"`{scheduled_days}`")
    delay = real - sched
    return df.withColumns(
        {
            "actual_delivery_date": add_days(order_date, real),
            "scheduled_delivery_date": add_days(order_date, sched),
            "delay_days": delay,
        }
    ).withColumn(
        "calculated_status",
        F.when(F.col("delay_days") > 0, F.lit(STATUS_LATE))
        .when(F.col("delay_days") < 0, F.lit(STATUS_EARLY))
        .otherwise(F.lit(STATUS_ON_TIME)),
    )


def status_match(
    df: DataFrame,
    status_col: str = "calculated_status",
    source_col: str = "Delivery Status",
) -> DataFrame:
    """One row: how many computed statuses equal the stripped source status."""
    matched = F.count_if(F.col(status_col) == strip_py(F.col(f"`{source_col}`")))
    total = F.count(F.lit(1))
    return df.agg(
        matched.alias("matched"),
        total.alias("total"),
        pct_of(matched, total).alias("match_pct"),
    )


# --------------------------------------------------------------------------
# 4. route segment
# --------------------------------------------------------------------------
def add_route_segment(
    df: DataFrame,
    parts: Sequence[str] = ("Shipping Mode", "Market", "Order Region"),
    sep: str = ROUTE_SEPARATOR,
    max_len: int = ROUTE_MAX_LENGTH,
) -> DataFrame:
    """``route_segment`` = stripped parts joined by ``sep``, cut to ``max_len``.

    NULL in any part gives NULL (``concat``, not ``concat_ws``).
    """
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(strip_py(F.col(f"`{p}`")))
    return df.withColumn("route_segment", F.substring(F.concat(*pieces), 1, max_len))


def segment_count(df: DataFrame, col: str = "route_segment") -> DataFrame:
    return df.agg(F.count_distinct(col).alias("segment_count"))


def segment_top(df: DataFrame, n: int = TOP_SEGMENTS, col: str = "route_segment") -> DataFrame:
    """The ``n`` most common segments (ties by name). A top-k report, so
    Spark plans it as TakeOrderedAndProject over the partial counts."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("shipments"))
        .orderBy(F.col("shipments").desc(), F.col(col).asc())
        .limit(n)
    )


# --------------------------------------------------------------------------
# 5. cost
# --------------------------------------------------------------------------
def add_cost_metrics(
    df: DataFrame,
    sales: str = "Sales",
    profit: str = "Order Profit Per Order",
) -> DataFrame:
    """``implied_total_cost`` = sales - profit (exact decimal) and
    ``cost_pct_revenue`` = cost / sales * 100 as a double, 0 when sales is 0
    and NULL when sales is NULL."""
    s = F.col(f"`{sales}`")
    cost = s - F.col(f"`{profit}`")
    return df.withColumn("implied_total_cost", cost).withColumn(
        "cost_pct_revenue",
        F.when(s.isNull(), F.lit(None).cast("double"))
        .when(
            s != 0,
            F.col("implied_total_cost").cast("double") / s.cast("double") * F.lit(100.0),
        )
        .otherwise(F.lit(0.0)),
    )


def negative_profit_share(df: DataFrame, profit: str = "Order Profit Per Order") -> DataFrame:
    neg = F.count_if(F.col(f"`{profit}`") < 0)
    total = F.count(F.lit(1))
    return df.agg(
        neg.alias("negative_profit_orders"),
        total.alias("total_orders"),
        pct_of(neg, total).alias("negative_profit_pct"),
    )


# --------------------------------------------------------------------------
# 6. names
# --------------------------------------------------------------------------
def sql_friendly_columns(df: DataFrame) -> DataFrame:
    """Export names for all columns; two columns with one name are an error."""
    names = [sql_friendly_name(c) for c in df.columns]
    lower = [n.lower() for n in names]
    clashes = sorted({n for n in names if lower.count(n.lower()) > 1})
    if clashes:
        raise ValueError(f"several columns would be exported as {', '.join(clashes)}")
    return df.toDF(*names)


# --------------------------------------------------------------------------
# whole cleaning
# --------------------------------------------------------------------------
def clean_features(first_lines: DataFrame) -> DataFrame:
    """Feature steps on rows that are already one per order: parse dates,
    delivery features, route segment, cost metrics, export names."""
    df = parse_dates(first_lines)
    df = derive_delivery(df)
    df = add_route_segment(df)
    df = add_cost_metrics(df)
    return sql_friendly_columns(df)


def clean_shipments(
    raw: DataFrame,
    order_by: Sequence[str | Column],
    drop: Sequence[str] = (),
    key: str = "Order Id",
    also: Sequence[Column] = (),
) -> DataFrame:
    """Raw order lines -> cleaned shipments, one row per order.

    ``order_by`` defines "first line" (file position for file input, the line
    sort key for the test adapter); ``drop`` removes helper columns after the
    de-duplication. Parsing is row-wise and the "first line" order does not
    use the parsed dates, so the dates are parsed after the de-duplication:
    same rows, one parse per order instead of one per line. ``also`` adds
    aggregates over the lines of each order.
    """
    df = dedup_first(raw, [key], order_by, also)
    if drop:
        df = df.drop(*drop)
    return clean_features(df)
