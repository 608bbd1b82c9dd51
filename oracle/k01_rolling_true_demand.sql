SELECT product_id, product_name, category, pattern_group, sale_date, units_demanded,
       round(avg(units_demanded) OVER last_rows, 2) AS rolling_7d_avg_demand,
       CAST(sum(units_demanded) OVER last_rows AS BIGINT) AS rolling_7d_total_demand
FROM sales JOIN products USING (product_id)
WINDOW last_rows AS (PARTITION BY product_id ORDER BY sale_date ROWS 6 PRECEDING)
