"""Labels and bounds the reports print or compare with.

Fixed values throughout: the texts and numbers below are part of the result contract.
"""

PROMOTIONS = [(1, False, "No Promotion"), (2, True, "Holiday Promotion")]
HOLIDAY_FLAG = "1"

# reorder points
REORDER_STATUS = ["Out of Stock", "Below Reorder Point", "Near Reorder Point", "Adequate Stock"]
SEASONAL_STATUS = [
    "Out of Stock", "Below Seasonal Reorder Point", "Near Seasonal Reorder Point", "Adequate Stock",
]
LEAD_DAYS = 7
SAFETY_Z = 1.5
NEAR_FACTOR = 1.2
MIN_OBSERVATIONS = 7

# turnover
TURNOVER_HIGH = 3
TURNOVER_MODERATE = 1
PERIOD_DAYS = 30
TURNOVER_LABELS = ["High Turnover", "Moderate Turnover", "Low Turnover", "No Sales"]

# risk
RISK_BOUNDS = (0.75, 0.4, 0.2)
RISK_LABELS = ["High Risk", "Moderate Risk", "Low Risk", "Safe"]
STOCKOUT_BOUNDS = (0.3, 0.1)
STOCKOUT_LABELS = ["High Risk", "Moderate Risk", "Low Risk", "No Stockouts"]
GROWTH = (12, 10)  # replenished when inventory exceeds 12/10 of the previous level

# stock adjustment
ADJUSTMENT_LABELS = ["Order More", "Reduce Stock", "Hold Steady"]
REDUCE_FACTOR = 2

# supplier inconsistency
INCONSISTENCY_MONTHS = 3
LOW_STOCK = 80
INCONSISTENCY_BOUNDS = (0.17, 0.6, 0.9)
INCONSISTENCY_LABELS = [
    "Frequent Stockouts", "Erratic Ordering", "Erratic Fulfillment", "Consistent",
]

# demand trend
TREND_MONTHS = 3
TREND_UP = 1.1
TREND_DOWN = 0.9
TREND_LABELS = ["Upward", "Downward", "Stable"]
SUMMARY_LABELS = ["Mostly Upward", "Mostly Downward", "Mostly Stable", "Mixed"]

# KPI traffic lights: green bound, yellow bound, and whether large or small values are good
KPI_BOUNDS = {
    "average_stock_level": (100, 70, "high"),
    "stockout_rate": (0.1, 0.3, "low"),
    "inventory_turnover": (2.5, 1.5, "high"),
    "sell_through_rate": (70, 50, "high"),
}
LIGHTS = ["green", "yellow", "red", "gray"]

# boards
BOARD_STATUS = ["Out of Stock", "Below Reorder", "Near Reorder", "Adequate Stock"]
BOARD_BELOW = 10
BOARD_NEAR = 20
