SELECT p.category, CAST(sum(i.is_stockout) AS BIGINT) AS stockout_days, count(*) AS days_tracked,
       avg(i.is_stockout) AS stockout_rate
FROM inventory i JOIN products p USING (product_id)
GROUP BY ALL
