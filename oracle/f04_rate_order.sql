WITH rates AS (
    SELECT p.pattern_group, CAST(sum(i.is_stockout) AS BIGINT) AS stockout_days, count(*) AS days_tracked,
           avg(i.is_stockout) AS stockout_rate
    FROM inventory i JOIN products p USING (product_id) GROUP BY ALL
)
SELECT *, rank() OVER (ORDER BY stockout_rate DESC) AS place, count(*) OVER (ORDER BY stockout_rate DESC) AS last_place
FROM rates
