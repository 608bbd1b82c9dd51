SELECT category, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM sales JOIN products USING (product_id) GROUP BY category
