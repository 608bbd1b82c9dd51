SELECT product_id, product_name, category, pattern_group, total_stockout_days, days_tracked, stockout_rate_pct,
       total_units_lost, CAST(revenue AS DOUBLE) AS estimated_revenue_lost,
       rank() OVER (PARTITION BY category ORDER BY total_stockout_days DESC) AS rank_in_category
FROM lost
QUALIFY rank_in_category <= 5
