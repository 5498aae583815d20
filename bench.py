"""Benchmark: headline analyses at $BENCH_SF_DIR on local[$BENCH_CPUS].

1. ``shipments_build``: test tables -> raw order lines -> cleaned shipments,
   written as Parquet to the session's checkpoint folder (one warm-up run of
   the plan, then the median of ``$BENCH_RUNS`` builds; the last one is the
   table the analyses read).
2. Each headline analysis over that table: one warm-up run, then the median
   of ``$BENCH_RUNS`` runs. A run executes the full plan into Spark's
   ``noop`` sink (nothing collected to the driver).

Prints one JSON line on stdout; logs go to stderr. Set ``BENCH_EVENT_LOG_DIR``
to a scratch folder to keep Spark's event log (stage and task times).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "status_breakdown",
    "segment_scorecard",
    "corridor_risk",
    "iqr_anomalies",
    "cost_erosion",
    "rolling_trends",
    "inventory_build",
    "inventory_health",
    "route_lookup",
    "kpi_on_time_by_mode",
    "kpi_cost_share",
    "kpi_anomaly_share",
    "kpi_critical_products",
    # over all raw lines
    "parse_dates",
    "null_date_count",
    "dedup_orders",
    "dedup_stats",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    from freightlens.plans import tables
    from freightlens.plans.catalog import QUERIES
    from freightlens.plans.session import build_session

    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    event_dir = os.environ.get("BENCH_EVENT_LOG_DIR")  # stage/task times, no UI
    if event_dir:
        os.makedirs(event_dir, exist_ok=True)
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir})
    spark = build_session(
        f"local[{cpus}]",
        app_name="freightlens-bench",
        shuffle_partitions=max(cpus, 8),
        extra=extra,
    )
    times: dict[str, float] = {}

    def timed(make_df) -> float:
        _run(make_df())  # warm-up
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            _run(make_df())
            samples.append(time.perf_counter() - t)
        return round(statistics.median(samples), 3)

    # Cleaning as one plan from the test tables (joins, first line per order,
    # feature columns), then the one-time write of the shared table.
    _run(tables.shipments_lazy(spark, sf_dir))  # warm-up
    builds = []
    for _ in range(runs):
        t0 = time.perf_counter()
        tables.shipments(spark, sf_dir, refresh=True)
        builds.append(time.perf_counter() - t0)
    times["shipments_build"] = round(statistics.median(builds), 3)

    for name in HEADLINE:
        times[name] = timed(lambda: QUERIES[name](spark, sf_dir))

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
    }
    spark.stop()
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
