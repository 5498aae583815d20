from freightlens.operators.clean import (  # noqa: F401
    add_cost_metrics,
    add_route_segment,
    clean_shipments,
    dedup_first,
    dedup_stats,
    derive_delivery,
    negative_profit_share,
    null_date_count,
    parse_dates,
    segment_count,
    segment_top,
    sql_friendly_columns,
    status_match,
)
from freightlens.operators.inventory import (  # noqa: F401
    avg_demand,
    critical_products,
    daily_demand,
    inventory_build,
    inventory_health,
    latest_rolling,
    priority_critical_count,
    product_category,
    product_revenue,
    revenue_quartile,
    rolling_demand,
    stock_status_summary,
)
from freightlens.operators.margins import (  # noqa: F401
    cost_erosion,
    kpi_cost_share,
    kpi_on_time_by_mode,
    route_lookup,
)
from freightlens.operators.outliers import (  # noqa: F401
    anomaly_share,
    iqr_anomalies,
    iqr_bounds,
    iqr_flag_all,
)
from freightlens.operators.ranking import quantile_bucket, rank_below  # noqa: F401
from freightlens.operators.scoring import (  # noqa: F401
    RankComponent,
    corridor_metrics,
    corridor_risk,
    segment_metrics,
    segment_scorecard,
    weighted_percent_rank,
)
from freightlens.operators.trends import daily_stats, rolling_trends  # noqa: F401
from freightlens.operators.views import (  # noqa: F401
    delivery_analysis,
    publish_view,
    row_count,
    status_breakdown,
    status_crosstab,
)
