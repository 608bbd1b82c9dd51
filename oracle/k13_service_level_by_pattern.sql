WITH levels AS (
    SELECT p.pattern_group, i.product_id, 1 - avg(i.is_stockout) AS level
    FROM inventory i JOIN products p USING (product_id) GROUP BY ALL
)
SELECT pattern_group, round(avg(level), 9) AS mean, round(stddev_samp(level), 9) AS std, min(level) AS min,
       max(level) AS max, count(*) FILTER (WHERE level >= 0.95) AS products_on_target,
       CASE WHEN avg(level) >= 0.95 THEN 1 ELSE 0 END AS meets_target
FROM levels GROUP BY pattern_group
