"""The order of the sorted reports, which the comparison with SQL does not see."""

from __future__ import annotations

import pytest

from freightlens.plans.catalog import QUERIES
from tests.conftest import SF_MEDIUM

# Columns and whether they descend.
ORDERS = {
    "status_breakdown": [("order_count", True)],
    "status_crosstab": [("calc_delivery_status", False), ("count", True)],
    "segment_scorecard": [("reliability_score", True), ("route_segment", False)],
    "corridor_risk": [("risk_score", True)],
    "cost_erosion": [("profit_margin_pct", False)],
    "inventory_health": [("days_of_stock", False)],
    "rolling_trends": [("Shipping_Mode", False), ("order_day", False)],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, name):
    rows = QUERIES[name](spark, SF_MEDIUM).collect()
    assert len(rows) > 1
    for a, b in zip(rows, rows[1:]):
        for col, descending in ORDERS[name]:
            if a[col] != b[col]:
                assert (a[col] > b[col]) if descending else (a[col] < b[col]), (a, b)
                break
