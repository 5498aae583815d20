"""The cleaning job end to end: raw export -> three tables on disk.

Reads the raw order-line export and writes:

* ``shipments``, the cleaned table (one row per order);
* ``inventory``, one row per product with demand, quartile and stock band;
* ``route_segment_lookup``, one row per route segment;
* ``rejected_lines`` where the export has lines that cannot be read.

The tables become visible together (see ``plans.publish``): a run that fails
leaves the ones before it in place. The figures that the cleaning reports are
observed while the tables are written, without another scan.

The shipments are written first, with the position of their line, to the
shared folder, and all outputs start from those files, not from the
de-duplication's lineage. A lost executor then re-reads Parquet instead of
re-running the cleaning. All columns of the export are kept; the line position
decides a product's first category and is left out of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from freightlens.constants import STOCK_BAND_OVER, STOCK_BANDS
from freightlens.functions.columns import parse_timestamp, strip_py
from freightlens.operators.clean import RAW_DATE_COLUMNS, clean_shipments
from freightlens.operators.inventory import inventory_build
from freightlens.operators.margins import route_lookup
from freightlens.operators.sinks import write_csv_quoted, write_parquet
from freightlens.plans.publish import publish
from freightlens.plans.session import materialise
from freightlens.sources.files import (
    FILE_ORDER_KEY,
    REJECT_REASON,
    REJECTED_LINE,
    raw_order_lines_checked,
    read_raw_rejects_csv,
)
from freightlens.sources.schemas import RAW_DATE_FORMAT

# Per order, from its lines: how many there are, and how many without a date.
_LINES, _UNDATED = "_lines", "_undated_lines"


class CleaningResult(dict):
    """The paths of the published tables by name, and the ``counters`` observed
    while they were written, by the name of the operator that also gives them."""

    counters: dict[str, dict[str, float | int | None]]


def _share(n: int, total: int) -> float | None:
    return n * 100.0 / total if total else None


def _observed_shipments(ships: DataFrame, seen: Observation) -> DataFrame:
    """Counted at the last step before the write, from columns that the
    de-duplication carries along, so a stage that runs again counts once."""
    matched = F.col("calculated_status") == strip_py("Delivery_Status")
    return ships.observe(
        seen,
        F.coalesce(F.sum(_LINES), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(_UNDATED), F.lit(0)).alias("undated"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("Order_Profit_Per_Order") < 0).alias("negative"),
    )


def _observed_inventory(inventory: DataFrame, seen: Observation) -> DataFrame:
    bands = [label for _, label in STOCK_BANDS] + [STOCK_BAND_OVER]
    in_band = [F.count_if(F.col("stock_status") == b).alias(b) for b in bands]
    return inventory.observe(seen, F.count_if("priority_critical").alias("_priority"), *in_band)


def _counters(ships: dict, inventory: dict) -> dict[str, dict]:
    lines, orders = ships["lines"], ships["orders"]
    priority = inventory.pop("_priority")
    return {
        "null_date_count": {"null_order_dates": ships["undated"]},
        "dedup_stats": {"rows_before": lines, "rows_after": orders, "rows_removed": lines - orders},
        "status_match": {
            "matched": ships["matched"],
            "total": orders,
            "match_pct": _share(ships["matched"], orders),
        },
        "negative_profit_share": {
            "negative_profit_orders": ships["negative"],
            "total_orders": orders,
            "negative_profit_pct": _share(ships["negative"], orders),
        },
        "stock_status_summary": inventory,
        "priority_critical_count": {"priority_critical_products": priority},
    }


def _write(df: DataFrame, path: str, fmt: str) -> None:
    (write_csv_quoted if fmt == "csv" else write_parquet)(df, path)


def run_cleaning_job(
    spark: SparkSession,
    raw_path: str,
    out_dir: str,
    days_of_stock: Column | DataFrame,
    fmt: str = "parquet",
    encoding: str = "ISO-8859-1",
) -> CleaningResult:
    """Clean ``raw_path`` and publish the three tables in ``out_dir``.

    ``days_of_stock`` is the stock input per product (a column over
    ``product_id`` or a ``(product_id, days_of_stock)`` frame). Output is
    Parquet by default, or quoted CSV with ``fmt="csv"``. Returns the paths of
    this publication (``publish.published`` gives the latest one) and the
    counters; ``rejected_lines`` is among the paths only if there are such lines.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown output format {fmt!r}")
    options = {"encoding": encoding}
    rejected, seen, stock = (Observation(n) for n in ("rejected_lines", "shipments", "inventory"))
    raw = (
        raw_order_lines_checked(spark, raw_path, **options)
        .observe(rejected, F.count_if(F.col(REJECT_REASON).isNotNull()).alias("n"))
        .where(F.col(REJECT_REASON).isNull())
        .drop(REJECT_REASON, REJECTED_LINE)
    )
    undated = parse_timestamp(F.col(f"`{RAW_DATE_COLUMNS['order_date']}`"), RAW_DATE_FORMAT).isNull()
    per_order = [F.count(F.lit(1)).alias(_LINES), F.count_if(undated).alias(_UNDATED)]
    ships = clean_shipments(raw, order_by=[FILE_ORDER_KEY], also=per_order)
    ships = materialise(spark, _observed_shipments(ships, seen), "shipments").drop(_LINES, _UNDATED)
    inventory = inventory_build(ships, days_of_stock, order_key=FILE_ORDER_KEY)
    tables = {
        "shipments": ships.drop(FILE_ORDER_KEY),
        "inventory": _observed_inventory(inventory, stock),
        "route_segment_lookup": route_lookup(ships),
    }
    writers = {name: (lambda path, df=df: _write(df, path, fmt)) for name, df in tables.items()}
    if rejected.get["n"]:
        lines = read_raw_rejects_csv(spark, raw_path, **options)
        writers["rejected_lines"] = lambda path: write_parquet(lines, path)
    result = CleaningResult(publish(spark, out_dir, writers))
    result.counters = _counters(dict(seen.get), dict(stock.get))
    return result
