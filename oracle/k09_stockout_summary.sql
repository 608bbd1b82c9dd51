SELECT product_id, product_name, category, pattern_group, total_stockout_days, days_tracked, stockout_rate_pct,
       total_units_lost, CAST(revenue AS DOUBLE) AS estimated_revenue_lost
FROM lost
