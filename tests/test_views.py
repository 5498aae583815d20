"""The shared view as a SQL temp view (publish and replace)."""

from __future__ import annotations

from freightlens.operators.views import publish_view
from freightlens.plans import tables as P
from tests.conftest import SF_SMALL


def test_publish_view_and_query_with_sql(spark):
    da = P.view(spark, SF_SMALL)
    publish_view(da)
    n = spark.sql("SELECT count(*) FROM delivery_analysis").first()[0]
    assert n == da.count() == 1473
    # replacing the view with a filtered one is allowed (CREATE OR REPLACE)
    publish_view(da.where("delay_days > 0"))
    late = spark.sql("SELECT count(*) FROM delivery_analysis").first()[0]
    assert late == da.where("delay_days > 0").count() < n
    spark.catalog.dropTempView("delivery_analysis")
