"""Publishing tables together, and the counters of the cleaning job."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from freightlens.operators import clean, inventory as inv
from freightlens.plans import export
from freightlens.plans.publish import NotPublished, publish, published
from freightlens.sources import files
from tests.test_io import _export, _other_order, _row


def _writers(spark, mark, names=("a", "b", "c"), fails=None):
    def writer(name):
        def write(path):
            if name == fails:
                raise OSError("no more room")
            spark.createDataFrame([(mark, name)], "mark int, name string").write.parquet(path)

        return write

    return {name: writer(name) for name in names}


def _marks(spark, out):
    return {name: spark.read.parquet(p).first()["mark"] for name, p in published(spark, out).items()}


def test_all_tables_or_none(spark, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    with pytest.raises(NotPublished):
        published(spark, out)
    publish(spark, out, _writers(spark, 1))
    assert _marks(spark, out) == {"a": 1, "b": 1, "c": 1}
    for fails in ("b", "c"):
        with pytest.raises(OSError):
            publish(spark, out, _writers(spark, 2, fails=fails))
        assert _marks(spark, out) == {"a": 1, "b": 1, "c": 1}
    held = published(spark, out)
    publish(spark, out, _writers(spark, 3, names=("a", "b")))
    assert _marks(spark, out) == {"a": 3, "b": 3}
    assert spark.read.parquet(held["a"]).first()["mark"] == 1  # a reader that has begun
    publish(spark, out, _writers(spark, 4))
    assert _marks(spark, out) == {"a": 4, "b": 4, "c": 4}
    assert len(os.listdir(os.path.join(out, "versions"))) == 2  # the first one is gone, failed ones too


def test_a_manifest_being_written_is_not_seen(spark, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    publish(spark, out, _writers(spark, 1))
    with open(os.path.join(out, "manifests", "_half"), "w") as fh:
        fh.write('{"version": ')
    assert _marks(spark, out) == {"a": 1, "b": 1, "c": 1}


def _raw(tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    rows = [_row(i // 3, **{"Product Card Id": i % 7, "Sales": str(10 + i), "Delivery Status": s,
                            "Order Profit Per Order": str(i % 4 - 1), "order date (DateOrders)": d})
            for i, (s, d) in enumerate([(" Early ", "1/3/2018 22:56"), ("Late", "bad"), ("Early", "2/1/2018 1:00")] * 20)]
    _export(path, [*rows, "one,two"], _other_order())
    return path


def test_counters_equal_the_operators(spark, tmp_dir):
    path = _raw(tmp_dir)
    days = F.col("product_id").cast("double") + 2
    done = export.run_cleaning_job(spark, path, os.path.join(tmp_dir, "out"), days)
    raw = files.read_raw_order_lines_csv(spark, path)
    ships, stock = (spark.read.parquet(done[t]) for t in ("shipments", "inventory"))
    one = lambda df: df.first().asDict()
    assert done.counters == {
        "null_date_count": one(clean.null_date_count(clean.parse_dates(raw))),
        "dedup_stats": one(clean.dedup_stats(raw)),
        "status_match": one(clean.status_match(ships, source_col="Delivery_Status")),
        "negative_profit_share": one(clean.negative_profit_share(ships, profit="Order_Profit_Per_Order")),
        "stock_status_summary": {r["stock_status"]: r["products"] for r in inv.stock_status_summary(stock).collect()},
        "priority_critical_count": one(inv.priority_critical_count(stock)),
    }
    assert done.counters["dedup_stats"]["rows_before"] == 60
    assert done.counters["null_date_count"]["null_order_dates"] == 20
    assert set(done) == {"shipments", "inventory", "route_segment_lookup", "rejected_lines"}


def test_a_failing_job_leaves_the_tables_before_it(spark, tmp_dir, monkeypatch):
    path, out = _raw(tmp_dir), os.path.join(tmp_dir, "out")
    first = export.run_cleaning_job(spark, path, out, F.lit(5.0))

    def broken(*_):
        raise OSError("lost")

    written = []
    write = export._write
    monkeypatch.setattr(export, "_write", lambda df, p, fmt: written.append(p) if write(df, p, fmt) or len(written) < 1 else broken())
    with pytest.raises(OSError):
        export.run_cleaning_job(spark, path, out, F.lit(9.0))
    assert len(written) == 1  # the first table had been written
    assert published(spark, out) == dict(first)
    assert spark.read.parquet(published(spark, out)["inventory"]).first()["days_of_stock"] == 5.0
