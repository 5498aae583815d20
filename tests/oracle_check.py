"""Compare a catalog query with its DuckDB oracle on the same Parquet tables.

Values are compared as an order-insensitive multiset of rows, with columns
sorted by name. Each value is rendered canonically (floats by ``repr``,
decimals normalised, timestamps ISO), so the comparison is exact.

Run as a script to check every query:
    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import math
import os
import sys

import duckdb

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if REPO not in sys.path:
    sys.path.insert(0, REPO)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_DUCK_TO_SPARK = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        if v == 0:
            return "0"
        return format(v.normalize(), "f")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _rows(names: list[str], rows) -> collections.Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    s_names = df.columns
    s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    s_rows = df.collect()

    con = con or duck_connection(sf_dir)
    rel = con.sql(oracle_sql()[name])
    d_names = rel.columns
    d_types = {n: _DUCK_TO_SPARK.get(str(t), str(t).lower()) for n, t in zip(d_names, rel.types)}
    d_rows = rel.fetchall()

    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(s_names) == sorted(d_names),
        "type_diffs": {
            c: (s_types.get(c), d_types.get(c))
            for c in sorted(set(s_names) | set(d_names))
            if s_types.get(c) != d_types.get(c)
        },
    }
    if out["columns_match"]:
        a, b = _rows(s_names, s_rows), _rows(d_names, d_rows)
        out["values_match"] = a == b
        if a != b:
            only_s = list((a - b).elements())[:3]
            only_d = list((b - a).elements())[:3]
            out["diff_sample"] = {"spark_only": only_s, "oracle_only": only_d,
                                  "columns": sorted(s_names)}
    else:
        out["values_match"] = False
        out["columns"] = {"spark": sorted(s_names), "oracle": sorted(d_names)}
    return out


def main(argv: list[str]) -> int:
    from freightlens.plans.session import build_session
    from __spark_entry__ import oracle_sql

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(oracle_sql())
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            print(f"{n:26s} ERROR {type(e).__name__}: {str(e)[:300]}", flush=True)
            bad += 1
            continue
        ok = r["values_match"] and r["spark_rows"] == r["oracle_rows"]
        bad += not ok
        status = "OK  " if ok else "FAIL"
        extra = "" if not r["type_diffs"] else f" types={r['type_diffs']}"
        print(f"{n:26s} {status} rows={r['spark_rows']}/{r['oracle_rows']}{extra}", flush=True)
        if not ok:
            print("   ", {k: v for k, v in r.items() if k in ("columns", "diff_sample")}, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
