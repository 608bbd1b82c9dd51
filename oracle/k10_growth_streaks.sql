SELECT product_id, product_name, category, pattern_group, consecutive_growth_months, streak_start, streak_end
FROM growth JOIN products USING (product_id)
