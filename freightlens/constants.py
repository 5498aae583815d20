"""Fixed values.

Everything here must equal the original analysis for the results to match:
labels, thresholds, weights and text formats. They are kept in one place, in
the order the analysis uses them. The operators take them as parameter
defaults.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Raw export and cleaning
# --------------------------------------------------------------------------
RAW_DATE_FORMAT = "M/d/yyyy H:mm"
RAW_ENCODING = "ISO-8859-1"
STATUS_LATE = "Late"
STATUS_EARLY = "Early"
STATUS_ON_TIME = "On Time"
ROUTE_SEPARATOR = " > "
ROUTE_MAX_LENGTH = 195
TOP_SEGMENTS = 5

# --------------------------------------------------------------------------
# Route segment scorecard
# --------------------------------------------------------------------------
SCORECARD_MIN_SHIPMENTS = 50
SCORECARD_WEIGHTS = (0.35, 0.25, 0.25, 0.15)  # on time, delay, cost, volume
SCORECARD_TIERS = (80.0, 60.0)
SCORECARD_LABELS = ("Preferred", "Acceptable", "Under Review")

# --------------------------------------------------------------------------
# Corridor risk
# --------------------------------------------------------------------------
RISK_MIN_ORDERS = 50
RISK_WEIGHTS = (0.30, 0.30, 0.20, 0.20)  # cancel/fraud, late, discount, volatility
RISK_TIERS = (70.0, 40.0)
RISK_LABELS = ("High Risk", "Moderate Risk", "Low Risk")
CANCEL_STATUSES = ("CANCELED", "SUSPECTED_FRAUD")
RECOMMENDATION_LIMITS = (5.0, 15.0, 60.0, 0.5)  # cancel %, discount %, late %, volatility
RECOMMENDATIONS = (
    "Investigate Fraud Pattern",
    "Reduce Discount",
    "Restrict Shipping Mode",
    "Stabilise Pricing",
    "Monitor",
)

# --------------------------------------------------------------------------
# IQR outliers
# --------------------------------------------------------------------------
IQR_QUARTILES = (0.25, 0.75)
IQR_K_MILD = 1.5
IQR_K_EXTREME = 3.0
ANOMALY_FLAGS = ("Extreme", "Outlier", "Normal")
ANOMALY_DIRECTIONS = ("Unusually Late", "Unusually Early", "Within Range")
RANGE_JOINER = " to "

# --------------------------------------------------------------------------
# Margin erosion
# --------------------------------------------------------------------------
EROSION_MIN_ORDERS = 20
EROSION_COST_LIMIT = 80.0
COST_FLAGS = ("High Cost Route", "Normal")
PROFIT_FLAGS = ("UNPROFITABLE", "Profitable")

# --------------------------------------------------------------------------
# Inventory and stock cover
# --------------------------------------------------------------------------
QUARTILE_LABELS = ("Q1_Low", "Q2_Med", "Q3_High", "Q4_Top")
STOCK_BANDS = ((7, "Critical"), (14, "Warning"), (60, "Healthy"))
STOCK_BAND_OVER = "Overstocked"
PRIORITY_BAND = "Critical"
PRIORITY_QUARTILE = "Q4_Top"
ROLLING_ROWS = 30
NO_DEMAND_COVER = 999.0
