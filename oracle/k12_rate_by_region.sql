SELECT s.region, CAST(sum(i.is_stockout) AS BIGINT) AS stockout_days, count(*) AS days_tracked,
       avg(i.is_stockout) AS stockout_rate
FROM inventory i JOIN sales s ON s.product_id = i.product_id AND s.sale_date = i.snapshot_date
GROUP BY ALL
