"""The driver contract: every query returns a DataFrame with unique column
names and only the reported types, and has an oracle with the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from freightlens.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


def test_contract(spark):
    from __spark_entry__ import oracle_sql, queries

    q, o = queries(), oracle_sql()
    assert set(QUERIES) <= set(q) and set(QUERIES) <= set(o) and set(o) <= set(q)
    assert len(QUERIES) == 45
    for name in QUERIES:
        fn = q[name]
        df = fn(spark, SF_SMALL)
        assert isinstance(df, DataFrame), name
        cols = df.columns
        assert len(cols) == len(set(cols)), name
        assert not any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields), name
        assert "SELECT" in o[name].upper(), name
