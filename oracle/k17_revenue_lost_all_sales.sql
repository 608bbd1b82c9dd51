SELECT p.category, CAST(sum((s.units_demanded - s.units_sold) * p.unit_price) AS DOUBLE) AS revenue_lost
FROM sales s JOIN products p USING (product_id) GROUP BY p.category
