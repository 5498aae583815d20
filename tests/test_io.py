"""Readers and writers: Latin-1 raw CSV, quoted export that keeps blanks."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException

from freightlens.operators import clean
from freightlens.operators.sinks import write_csv_quoted, write_parquet
from freightlens.sources import files
from freightlens.sources.schemas import RAW_ORDER_LINE_SCHEMA


def _raw_line(order_id, region, country, sales, date="1/31/2018 22:56"):
    vals = [
        str(order_id), date, "2/3/2018 22:56", "3", "4", "Advance shipping", "0",
        "Standard Class", "LATAM", f'"{region}"', sales, "12.5000", "1360", "1",
        '"Smart watch, black"', "COMPLETE", "Consumer", "0.04", "0.29", "Watch", country,
        "18.25", "-66.04",
    ]
    return ",".join(vals)


def test_raw_csv_latin1_quotes_and_accents(spark, tmp_dir):
    header = ",".join(f'"{f.name}"' for f in RAW_ORDER_LINE_SCHEMA.fields)
    lines = [header, _raw_line(1, "South of  USA", "Japón", "327.75"),
             _raw_line(1, "South of  USA", "Japón", "1.00"),
             _raw_line(2, "Caribbean", "EE. UU.", "10.00", date="bad date")]
    path = os.path.join(tmp_dir, "raw.csv")
    with open(path, "wb") as fh:
        fh.write(("\n".join(lines) + "\n").encode("latin-1"))
    raw = files.read_raw_order_lines_csv(spark, path)
    rows = raw.orderBy(files.FILE_ORDER_KEY).collect()
    assert len(rows) == 3
    assert rows[0]["Order Country"] == "Japón"
    assert rows[0]["Order Region"] == "South of  USA"
    assert rows[0]["Category Name"] == "Smart watch, black"
    assert rows[0]["Sales"] == Decimal("327.75")
    ships = clean.clean_shipments(raw, order_by=[files.FILE_ORDER_KEY], drop=[files.FILE_ORDER_KEY])
    got = {r["Order_Id"]: r for r in ships.collect()}
    assert got[1]["Sales"] == Decimal("327.75")  # first line in the file wins
    assert got[2]["order_date"] is None
    assert clean.null_date_count(clean.parse_dates(raw)).first()[0] == 1


def _export(path, rows, columns, encoding="latin-1"):
    """Write rows (dicts) as a quoted export with its columns in this order."""
    lines = [",".join(f'"{c}"' for c in columns)]
    lines += [r if isinstance(r, str) else ",".join(f'"{r[c]}"' for c in columns) for r in rows]
    with open(path, "wb") as fh:
        fh.write(("\n".join(lines) + "\n").encode(encoding))


def _row(order_id, **changes):
    names = [f.name for f in RAW_ORDER_LINE_SCHEMA.fields]
    values = [
        order_id, "1/31/2018 22:56", "2/3/2018 22:56", 3, 4, "Advance shipping", 0,
        "Standard Class", "LATAM", "Caribbean", "299.9800110", "-249.0899963", 1360, 1,
        "Smart watch", "COMPLETE", "Consumer", "0.039999999", "0.289999992", "Watch", "Japón",
        "18.25", "-66.04",
    ]
    return dict(zip(names, values)) | {"Customer City": "Caguas", "Type": "DEBIT"} | changes


def _other_order():
    return ["Type", *[f.name for f in RAW_ORDER_LINE_SCHEMA.fields][::-1], "Customer City"]


def test_raw_columns_are_found_by_name_and_no_digit_is_lost(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    _export(path, [_row(20), _row(5, Sales="1e-05"), _row(7, Sales="12")], _other_order())
    rows = {r["Order Id"]: r for r in files.read_raw_order_lines_csv(spark, path).collect()}
    assert set(rows) == {20, 5, 7}
    assert rows[20]["Sales"] == Decimal("299.9800110")
    assert rows[20]["Order Profit Per Order"] == Decimal("-249.0899963")
    assert rows[20]["Order Item Discount Rate"] == Decimal("0.039999999")
    assert rows[20]["Order Item Profit Ratio"] == Decimal("0.289999992")
    assert rows[5]["Sales"] == Decimal("0.00001") and rows[7]["Sales"] == 12
    assert rows[20]["Shipping Mode"] == "Standard Class" and rows[20]["Customer City"] == "Caguas"


def test_a_missing_column_is_named(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    _export(path, [_row(1)], [c for c in _other_order() if c != "Sales"])
    with pytest.raises(ValueError, match="Sales"):
        files.read_raw_order_lines_csv(spark, path)


def test_bad_lines_are_rejected_never_merged(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    columns = _other_order()
    rows = [_row(1), _row("A1"), _row("A2"), _row(""), "one,two", _row(2, Sales="1.0000000000001"),
            _row(3, Latitude="north"), _row(4)]
    _export(path, rows, columns)
    good = files.read_raw_order_lines_csv(spark, path)
    assert sorted(r["Order Id"] for r in good.collect()) == [1, 4]
    rejects = files.read_raw_rejects_csv(spark, path).orderBy(files.FILE_ORDER_KEY).collect()
    assert [r["reject_reason"] for r in rejects] == [
        "Order Id", "Order Id", "Order Id", "broken line", "Sales", "Latitude"]
    assert '"A1"' in rejects[0]["rejected_line"] and rejects[3]["rejected_line"] == "one,two"
    out = os.path.join(tmp_dir, "out")
    from pyspark.sql import functions as F

    from freightlens.plans.export import run_cleaning_job

    paths = run_cleaning_job(spark, path, out, F.lit(5.0))
    assert spark.read.parquet(paths["rejected_lines"]).count() == 6
    assert spark.read.parquet(paths["shipments"]).count() == 2


def test_line_breaks_in_quotes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    names = ["Watch", "two\nlines", "Watch"]
    _export(path, [_row(i + 1, **{"Product Name": n}) for i, n in enumerate(names)], _other_order())
    rows = files.read_raw_order_lines_csv(spark, path).orderBy(files.FILE_ORDER_KEY).collect()
    assert [(r["Order Id"], r["Product Name"]) for r in rows] == [(1, "Watch"), (2, "two\nlines"), (3, "Watch")]
    assert files.read_raw_rejects_csv(spark, path).count() == 0


def test_snapshot_columns_are_found_by_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "inventory.csv")
    with open(path, "w") as fh:
        fh.write('"category_name","product_id","note","days_of_stock","revenue_quartile","priority_critical",'
                 '"stock_status","simulated_stock","avg_daily_demand_30d"\n'
                 '"Toys ","7","x","3.5","Q1","True","Low","12","1.5"\n')
    row = files.read_inventory_csv(spark, path).first()
    assert row.asDict() == {
        "product_id": 7, "avg_daily_demand_30d": 1.5, "category_name": "Toys ", "revenue_quartile": "Q1",
        "days_of_stock": 3.5, "simulated_stock": 12, "stock_status": "Low", "priority_critical": True}
    with open(path, "w") as fh:
        fh.write('"route_segment","late_count"\n"a","1"\n')
    with pytest.raises(ValueError, match="avg_delay"):
        files.read_route_lookup_csv(spark, path)


def test_cleaning_keeps_all_columns_and_file_order(spark, tmp_dir):
    from pyspark.sql import functions as F

    from freightlens.plans.export import run_cleaning_job

    path = os.path.join(tmp_dir, "raw.csv")
    rows = [_row(20, **{"Category Name": "First"}), _row(5, **{"Category Name": "Second"})]
    _export(path, rows, _other_order())
    paths = run_cleaning_job(spark, path, os.path.join(tmp_dir, "out"), F.lit(5.0))
    assert "rejected_lines" not in paths
    ships = spark.read.parquet(paths["shipments"])
    assert {r["Customer_City"] for r in ships.collect()} == {"Caguas"}
    assert files.FILE_ORDER_KEY not in ships.columns
    assert spark.read.parquet(paths["inventory"]).first()["category_name"] == "First"


def test_missing_input_is_an_error(spark, tmp_dir):
    with pytest.raises(AnalysisException):
        files.read_raw_order_lines_csv(spark, os.path.join(tmp_dir, "nope.csv")).count()


def test_quoted_csv_write_keeps_blanks_and_reads_back(spark, tmp_dir):
    inv = spark.createDataFrame(
        [(1348, 45.16666666666666, "CDs ", "Q1_Low", 12.0, 542, "Warning", False),
         (7, 1.5, " Japón", "Q4_Top", 3.0, 4, "Critical", True)],
        files.INVENTORY_SCHEMA,
    )
    out = os.path.join(tmp_dir, "inv")
    write_csv_quoted(inv.coalesce(1), out)
    text = open(glob.glob(os.path.join(out, "part-*.csv"))[0], encoding="utf-8").read()
    assert '"CDs "' in text and '" Japón"' in text and '"false"' in text
    back = files.read_inventory_csv(spark, out).orderBy("product_id").collect()
    assert [r["category_name"] for r in back] == [" Japón", "CDs "]
    assert back[1]["priority_critical"] is False and back[0]["priority_critical"] is True
    assert back[1]["avg_daily_demand_30d"] == 45.16666666666666


def test_route_lookup_quoted_read(spark, tmp_dir):
    path = os.path.join(tmp_dir, "route.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('"route_segment","total_shipments","avg_delay","late_count","avg_sales",'
                 '"avg_profit","on_time_rate"\n')
        fh.write('"First Class > USCA > South of  USA","197","1.0","187","166.9","21.7",'
                 '"5.076142131979699"\n')
    r = files.read_route_lookup_csv(spark, path).first()
    assert r["route_segment"] == "First Class > USCA > South of  USA"
    assert r["total_shipments"] == 197 and r["on_time_rate"] == 5.076142131979699


def test_parquet_sink_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("a ", 1), ("b", 2)], "k string, v int")
    out = os.path.join(tmp_dir, "pq")
    write_parquet(df, out, partition_by=["v"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a ", 1), ("b", 2)]


def test_cleaning_job_writes_three_tables(spark, tmp_dir):
    from pyspark.sql import functions as F

    from freightlens.plans.export import run_cleaning_job

    header = ",".join(f'"{f.name}"' for f in RAW_ORDER_LINE_SCHEMA.fields)
    lines = [header,
             _raw_line(1, "South of  USA", "Japón", "327.75"),
             _raw_line(1, "South of  USA", "Japón", "1.00"),
             _raw_line(2, "Caribbean", "EE. UU.", "10.00")]
    raw = os.path.join(tmp_dir, "raw.csv")
    with open(raw, "wb") as fh:
        fh.write(("\n".join(lines) + "\n").encode("latin-1"))
    for fmt in ("parquet", "csv"):
        out = os.path.join(tmp_dir, f"out_{fmt}")
        paths = run_cleaning_job(spark, raw, out, F.lit(5.0), fmt=fmt)
        if fmt == "parquet":
            ships = spark.read.parquet(paths["shipments"])
            inv = spark.read.parquet(paths["inventory"])
            lookup = spark.read.parquet(paths["route_segment_lookup"])
        else:
            ships = spark.read.option("header", True).csv(paths["shipments"])
            inv = files.read_inventory_csv(spark, paths["inventory"])
            lookup = files.read_route_lookup_csv(spark, paths["route_segment_lookup"])
        assert ships.count() == 2
        assert inv.count() == 1  # one product with dated demand
        r = inv.first()
        assert r["stock_status"] == "Critical" and r["days_of_stock"] == 5.0
        segs = {x["route_segment"]: x["total_shipments"] for x in lookup.collect()}
        assert segs == {"Standard Class > LATAM > South of  USA": 1, "Standard Class > LATAM > Caribbean": 1}


def test_inventory_csv_reads_python_style_booleans(spark, tmp_dir):
    path = os.path.join(tmp_dir, "inv.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('"product_id","avg_daily_demand_30d","category_name","revenue_quartile",'
                 '"days_of_stock","simulated_stock","stock_status","priority_critical"\n')
        fh.write('"1346","45.0","Books ","Q3_High","1.0","45","Critical","False"\n')
        fh.write('"7","2.0","X","Q4_Top","3.0","6","Critical","True"\n')
    rows = {r["product_id"]: r for r in files.read_inventory_csv(spark, path).collect()}
    assert rows[1346]["priority_critical"] is False and rows[7]["priority_critical"] is True
    assert rows[1346]["category_name"] == "Books "
