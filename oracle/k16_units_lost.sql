SELECT p.category, CAST(sum(s.units_demanded - s.units_sold) AS BIGINT) AS units_lost
FROM sales s JOIN inventory i ON i.product_id = s.product_id AND i.snapshot_date = s.sale_date
JOIN products p ON p.product_id = s.product_id
WHERE i.is_stockout = 1 GROUP BY p.category
