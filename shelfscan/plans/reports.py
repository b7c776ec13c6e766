"""The named reports, grouped by the table they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shelfscan.operators import explore, insights, quality

Operator = Callable[[DataFrame], DataFrame]

# over the raw listings
AUDIT: dict[str, Operator] = {
    "c01_row_count": quality.row_count(),
    "c02_skus_by_category": quality.skus_by_category,
    "c03_schema_overview": quality.column_catalogue(),
    "c04_preview": quality.preview,
    "c05_null_audit": quality.null_audit(),
    "c06_unpriced": quality.unpriced,
    "c07_negative_discounts": quality.negative_discounts,
    "c08_flag_values": quality.flag_values,
    "c09_priced_above_list": quality.priced_above_list,
    "c10_duplicate_keys": quality.duplicate_keys,
    "c13_rows_to_delete": quality.unpriced_count(),
    "c15_scale_in_paise": quality.scale_in_paise(),
    "c26_cleaning_report": quality.cleaning_report,
}

#: Those that ``quality.category_counts`` can answer.
FROM_CATEGORY_COUNTS = {"c02_skus_by_category", "c26_cleaning_report"}

# over the clean listings
VALIDATION: dict[str, Operator] = {
    "c17_scale_in_rupees": quality.scale_in_rupees(),
    "c21_remaining_nulls": quality.remaining_nulls(),
    "c22_unpriced_remaining": quality.unpriced_count("zero_mrp_remaining"),
    "c23_negative_remaining": quality.negative_discount_count(),
    "c24_clean_row_count": quality.row_count("cleaned_total_records"),
    "c25_clean_preview": lambda df: quality.preview(df, 10),
}
EXPLORATION: dict[str, Operator] = {
    "e01_summary_statistics": explore.summary_statistics,
    "e02_sku_distribution": explore.sku_distribution,
    "e03_discount_brackets": explore.discount_brackets,
    "e04_stock_share": explore.stock_share,
    "e05_stock_by_category": explore.stock_by_category,
    "e06_weight_tiers": explore.weight_tiers,
    "e07_price_per_gram_by_category": explore.price_per_gram_by_category,
    "e08_revenue_potential": explore.revenue_potential,
    "e09_revenue_by_category": explore.revenue_by_category,
}
BUSINESS: dict[str, Operator] = {
    "b01_top_discounts": insights.top_discounts,
    "b02_discount_by_category": insights.discount_by_category,
    "b03_premium_low_discount": insights.premium_low_discount,
    "b04_revenue_by_category": insights.revenue_by_category_in_stock,
    "b05_stockout_ranking": insights.stockout_ranking,
    "b06_best_value": insights.best_value,
    "b07_stockouts_by_discount_tier": insights.stockouts_by_discount_tier,
    "b08_top_inventory_value": insights.top_inventory_value,
    "b09_largest_markdowns": insights.largest_markdowns,
    "b10_quantity_by_category": insights.quantity_by_category,
    "b11_weight_tier_pricing": insights.weight_tier_pricing,
    "b12_critical_categories": insights.critical_categories,
    "b13_discount_histogram": insights.discount_histogram,
    "b14_pareto": insights.pareto,
    "b14_pareto_all": lambda df: insights.pareto(df, limit=None),
    "b15_cheap_and_stocked": insights.cheap_and_stocked,
    "b16_price_range": insights.price_range,
    "b17_lost_revenue": insights.lost_revenue,
    "b18_stock_comparison": insights.stock_comparison,
    "b19_deep_discounts": insights.deep_discounts,
    "b20_revenue_retention": insights.revenue_retention,
    "b21_executive_summary": insights.executive_summary,
}
FINDINGS: dict[str, Operator] = {
    "f1_discount_stockout_ratio": insights.discount_stockout_ratio,
    "f2_leading_category_share": insights.leading_category_share,
    "f3_deep_discount_count": insights.deep_discount_count,
    "f4_total_lost_revenue": insights.total_lost_revenue,
    "f5_overall_stockout_rate": insights.overall_stockout_rate,
}

# of these, the ones that need single listings; the others can be read from a cube
FROM_LISTINGS = {
    *VALIDATION,
    "e01_summary_statistics",
    "b01_top_discounts",
    "b03_premium_low_discount",
    "b06_best_value",
    "b09_largest_markdowns",
    "b14_pareto",
    "b14_pareto_all",
    "b15_cheap_and_stocked",
    "b16_price_range",
    "b19_deep_discounts",
    "b21_executive_summary",
}
