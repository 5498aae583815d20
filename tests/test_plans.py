"""Plan shapes the scale design relies on, checked with ``explain``."""

from __future__ import annotations

import contextlib
import io
import re

from freightlens.operators import clean, outliers, scoring
from freightlens.plans import tables as P
from freightlens.sources import tpch
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _tree(text: str) -> str:
    return text.split("\n\n(1)")[0]


def test_dedup_combines_before_the_shuffle(spark):
    lines = tpch.lineitem_lines(spark, SF_SMALL)
    text = _plan(clean.dedup_first(lines, ["l_orderkey"], tpch.LINE_ORDER))
    # the partial aggregate sits below the exchange on the order key
    assert re.search(r"Functions \[1\]: \[partial_min\(", text)
    tree = _tree(text).splitlines()
    exch = next(i for i, t in enumerate(tree) if "Exchange" in t)
    assert any("Aggregate" in t for t in tree[exch + 1 :])
    assert "hashpartitioning(l_orderkey" in text


def test_scorecard_single_shuffle_on_group_keys(spark):
    text = _plan(scoring.segment_metrics(P.view(spark, SF_SMALL), min_n=5))
    hashed = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert hashed and all(h.startswith("route_segment") for h in hashed)
    # column pruning reaches the scan: unused view columns are not read
    schema = re.search(r"ReadSchema: (struct<.*>)", text).group(1)
    assert "Product_Name" not in schema and "Latitude" not in schema


def test_outliers_have_no_join(spark):
    text = _tree(_plan(outliers.iqr_anomalies(P.view(spark, SF_SMALL))))
    assert "Join" not in text and "Cartesian" not in text


def test_first_lines_join_orders_without_reshuffling_lines(spark):
    text = _plan(P.first_order_lines(spark, SF_SMALL))
    # lines are shuffled once (by order key, for the first-line step);
    # the order join reuses that partitioning
    assert len(re.findall(r"hashpartitioning\(l_orderkey", text)) == 1


@contextlib.contextmanager
def _no_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _exchanged(text: str) -> list[tuple[str, str]]:
    """(rows' columns, partitioning) of every exchange in a formatted plan."""
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: ([^\n]*)", text)


def test_build_shuffles_wide_lines_by_order_key_only(spark):
    with _no_broadcasts(spark):
        text = _plan(P.first_order_lines(spark, SF_SMALL))
    below = text.split("Keys [1]: [l_orderkey")[0]  # what is planned before the aggregate
    lines = [a for cols, a in _exchanged(below) if "l_orderkey" in cols and "l_linenumber" in cols]
    assert not lines, lines
    assert len(re.findall(r"hashpartitioning\(l_orderkey", text)) == 1
    assert "LeftSemi" not in text and "LeftAnti" not in text


def test_dedup_orders_aggregates_below_the_joins(spark):
    from freightlens.plans.catalog import QUERIES

    with _no_broadcasts(spark):
        tree = _tree(_plan(QUERIES["dedup_orders"](spark, SF_SMALL))).splitlines()
    first = next(i for i, t in enumerate(tree) if "Aggregate" in t)
    joins = [i for i, t in enumerate(tree) if "SortMergeJoin" in t and "Anti" not in t]
    assert len([i for i in joins if i < first]) >= 2


def test_product_facts_hash_over_shipments(spark):
    from freightlens.operators import inventory as inv

    ships = P.shipments(spark, SF_SMALL)
    tree = _tree(_plan(inv.product_facts(ships))).splitlines()
    scan = next(i for i, t in enumerate(tree) if "Scan parquet" in t)
    above = [t for t in tree[:scan] if "Aggregate" in t][-1]
    assert "HashAggregate" in above
    assert _plan(P.inventory_lazy(spark, SF_SMALL)).count("Scan parquet") >= 1


def test_outliers_of_a_measure_hold_no_percentile(spark):
    text = _plan(outliers.iqr_anomalies(P.view(spark, SF_SMALL), col="Sales"))
    assert not re.search(r"(?<!_)percentile\(", text)
