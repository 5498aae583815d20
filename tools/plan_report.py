"""Write PLANS.md: the final (post-AQE) physical plan of each headline query.

For every query it lists the operator tree (details trimmed), the number of
shuffle exchanges and broadcasts, and what each Parquet scan reads
(``ReadSchema``) and pushes down (``PushedFilters``).

    python tools/plan_report.py [/root/testdata/sf0.01] [PLANS.md]

A development tool for the small test tables: AQE only finalises the plan of
the DataFrame that is executed, so each query is run with ``collect()``.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

HEADLINE = [
    "shipments",
    "segment_scorecard",
    "corridor_risk",
    "iqr_anomalies",
    "cost_erosion",
    "rolling_trends",
    "inventory_build",
    "inventory_health",
    "route_lookup",
    "status_breakdown",
]


def _formatted(df) -> str:
    """``explain("formatted")`` of the executed DataFrame (final AQE plan)."""
    df.collect()  # run this DataFrame's own execution so AQE finalises its plan
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _tree(text: str) -> list[str]:
    """Final-plan operator trees (main query, then each subquery), without
    the initial plan and without the per-node details."""
    out = []
    keep = True
    for line in text.splitlines():
        if re.match(r"^\(\d+\) ", line) or re.match(r"^Subquery:\d+ ", line):
            keep = False
        if line.startswith("===== Subqueries") or re.match(r"^Subquery:\d+ Hosting", line):
            keep = True
        if "== Initial Plan ==" in line:
            keep = False
        if line.startswith("==") or "== Final Plan ==" in line:
            if "Subqueries" in line:
                out.append(line)
            continue
        if "Hosting Expression = ReusedSubquery" in line:
            continue
        if keep and line.strip() and not line.strip() == "+-":
            out.append(re.sub(r"#\d+L?", "", line).rstrip()[:150])
        if line.startswith("AdaptiveSparkPlan") or line.startswith("Subquery:"):
            keep = True
    return out


def main(argv: list[str]) -> int:
    from freightlens.plans.catalog import QUERIES
    from freightlens.plans.session import build_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    target = argv[2] if len(argv) > 2 else os.path.join(REPO, "PLANS.md")
    spark = build_session(
        "local[8]", shuffle_partitions=8, extra={"spark.sql.maxMetadataStringLength": "2000"}
    )
    lines = [
        "# Physical plans",
        "",
        f"Final adaptive plans of the headline queries at `{os.path.basename(sf)}`,",
        "`local[8]`, written by `tools/plan_report.py`. `shipments` is the",
        "materialised table: the plan that builds it is shown under",
        "`shipments (build)`. Expression details are trimmed.",
        "",
    ]
    from freightlens.plans import tables

    plans = {"shipments (build)": tables.shipments_lazy(spark, sf)}
    plans.update({q: QUERIES[q](spark, sf) for q in HEADLINE if q != "shipments"})
    for name, df in plans.items():
        text = _formatted(df)
        tree = _tree(text)
        exchanges = sum(1 for t in tree if re.search(r"(?<!Broadcast)Exchange \(\d+\)", t))
        broadcasts = sum(1 for t in tree if re.search(r"BroadcastExchange \(\d+\)", t))
        subqueries = len(re.findall(r"^Subquery:\d+ ", text, re.M))
        reused = len(re.findall(r"Reused(Exchange|Subquery)", text))
        scans = re.findall(r"^ReadSchema: (.*)$", text, re.M)
        pushed = re.findall(r"^PushedFilters: (.*)$", text, re.M)
        lines += [
            f"## {name}",
            "",
            f"- shuffle exchanges: {exchanges}; broadcast exchanges: {broadcasts}; "
            f"subquery references: {subqueries} (reused: {reused})",
        ]
        for sch in sorted(set(scans)):
            lines.append(f"- scan reads `{sch}`")
        for p in sorted(set(pushed)):
            if p != "[]":
                lines.append(f"- pushed filters `{p}`")
        lines += ["", "```"] + tree + ["```", ""]
    # The build as it plans when no dimension fits the broadcast threshold
    # (the shape at large scale).
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    text = _formatted(tables.shipments_lazy(spark, sf))
    tree = _tree(text)
    exchanges = [t.strip() for t in re.findall(r"^\(\d+\) Exchange\n.*?Arguments: ([^\n]*)", text, re.M | re.S)]
    lines += [
        "## shipments (build) with broadcasts disabled",
        "",
        "The same plan with `autoBroadcastJoinThreshold=-1`, i.e. the shape when",
        "no dimension is small enough to broadcast. Shuffles:",
        "",
    ]
    seen: list[str] = []
    for e in exchanges:
        e = re.sub(r"#\d+L?", "", e.split(", ENSURE")[0])
        if e not in seen:
            seen.append(e)
    lines += [f"- `{e}`" for e in seen]
    lines += ["", "```"] + tree + ["```", ""]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    with open(target, "w") as fh:
        fh.write("\n".join(lines))
    print(f"wrote {target}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
