SELECT product_id, pattern_group, 1 - avg(is_stockout) AS achieved_service_level
FROM inventory JOIN products USING (product_id) GROUP BY product_id, pattern_group
