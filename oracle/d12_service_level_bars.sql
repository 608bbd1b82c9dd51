WITH levels AS (
    SELECT p.pattern_group, i.product_id, 1 - avg(i.is_stockout) AS level
    FROM inventory i JOIN products p USING (product_id) GROUP BY ALL
)
SELECT pattern_group, round(avg(level), 9) AS mean, round(stddev_samp(level), 9) AS std,
       round(avg(level) - stddev_samp(level), 9) AS low, round(avg(level) + stddev_samp(level), 9) AS high
FROM levels GROUP BY pattern_group
