from freightlens.functions.columns import (  # noqa: F401
    add_days,
    exact_mean,
    exact_stddev_samp,
    parse_timestamp,
    pct_of,
    round_half_up,
    sql_friendly_name,
    strip_py,
)
