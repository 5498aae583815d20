"""freightlens: shipment, order and stock analytics as Spark DataFrame operators.

Every operator is a function ``f(df, ..., *, params) -> DataFrame`` built from
built-in Spark expressions, so Catalyst plans it and the work is spread over
the cluster. Thresholds and weights are keyword parameters whose defaults are
the values the original analysis used.

Layout:

* ``constants`` the fixed labels, thresholds, weights and formats
* ``sources``   readers: raw order-line CSV, fixed-schema snapshots, and the
                adapter that maps the TPC-H style test tables to raw order lines
* ``functions`` column-expression helpers (rounding, ratios, exact moments)
* ``operators`` cleaning, the shared view, scorecards, outliers, inventory,
                trends, margins, and sinks
* ``plans``     end-to-end plans: table materialisation and the query catalog
"""

__version__ = "0.1.0"
