from .boards import (
    issue_heatmap, issue_map, kpi_traffic_lights, last_months, monthly_kpis, product_store_map,
    product_store_matrix, product_store_status, status_counts, status_pivot,
)
from .load import (
    bridge_store_regions, build_dimensions, dim_products, dim_promotions, dim_regions, dim_seasons, dim_stores,
    dim_weather, fact_snapshots, grow_dimensions, price_history, reject_counts, rejects,
)
from .risk import stockout_rate, stockout_risk, supplier_inconsistency
from .star import (
    ConflictError, Star, UnreadableError, append_star, compact_star, load_star, read_star, vacuum_star,
)
from .stock import (
    average_stock_level, current_stock, low_stock_alerts, reorder_points, seasonal_reorder_points,
    stock_adjustment,
)
from .trend import demand_trend, monthly_trend, seasonal_demand
from .turnover import (
    clean_region_month, dead_stock, inventory_age, monthly_turnover, sell_through_region_month,
    sell_through_store_month,
)

__all__ = [
    "ConflictError", "Star", "UnreadableError", "append_star", "average_stock_level", "bridge_store_regions", "build_dimensions",
    "clean_region_month", "compact_star", "current_stock", "dead_stock", "demand_trend", "dim_products",
    "dim_promotions", "dim_regions", "dim_seasons", "dim_stores", "dim_weather", "fact_snapshots",
    "grow_dimensions", "inventory_age", "issue_heatmap", "issue_map",
    "kpi_traffic_lights", "last_months", "load_star", "low_stock_alerts", "monthly_kpis", "monthly_trend",
    "monthly_turnover", "price_history", "product_store_map",
    "product_store_matrix", "product_store_status", "read_star", "reject_counts", "rejects", "reorder_points", "seasonal_demand", "seasonal_reorder_points",
    "sell_through_region_month", "sell_through_store_month", "status_counts", "status_pivot",
    "stock_adjustment", "stockout_rate", "stockout_risk", "supplier_inconsistency",
    "vacuum_star",
]
