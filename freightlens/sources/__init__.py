from freightlens.sources.files import (  # noqa: F401
    FILE_ORDER_KEY,
    read_inventory_csv,
    read_parquet,
    read_raw_order_lines_csv,
    read_route_lookup_csv,
)
from freightlens.sources.schemas import (  # noqa: F401
    INVENTORY_SCHEMA,
    RAW_DATE_FORMAT,
    RAW_ORDER_LINE_SCHEMA,
    ROUTE_LOOKUP_SCHEMA,
)
from freightlens.sources.tpch import (  # noqa: F401
    LINE_ORDER,
    LINE_SORT_KEY,
    raw_order_lines,
    read_table,
    stock_days_rule,
)
