WITH days AS (
    SELECT i.product_id, i.snapshot_date, COALESCE(s.units_demanded, 0) AS d
    FROM inventory i LEFT JOIN sales s ON s.product_id = i.product_id AND s.sale_date = i.snapshot_date
),
sums AS (
    SELECT product_id, snapshot_date,
           CAST(sum(d) OVER back AS DOUBLE) AS total, CAST(sum(d * d) OVER back AS DOUBLE) AS squares,
           CAST(least(date_diff('day', min(snapshot_date) OVER (PARTITION BY product_id), snapshot_date) + 1, 60) AS DOUBLE) AS n
    FROM days
    WINDOW back AS (PARTITION BY product_id ORDER BY snapshot_date RANGE BETWEEN INTERVAL 59 DAYS PRECEDING AND CURRENT ROW)
),
stats AS (SELECT product_id, snapshot_date, total / n AS mu, squares / n - (total / n) * (total / n) AS var FROM sums),
safety AS (
    SELECT product_id, snapshot_date, mu, CASE WHEN var <= 0 THEN 1.0 ELSE sqrt(var) END AS sigma, lead, lead_std,
           CAST(1.65 AS DOUBLE) * CASE WHEN var <= 0 THEN 1.0 ELSE sqrt(var) END * sqrt(lead) AS ss
    FROM stats JOIN lead_times USING (product_id)
)
SELECT product_id, snapshot_date, mu AS avg_daily_demand, sigma AS demand_std_dev, lead AS lead_time_days,
       lead_std AS lead_time_std_dev, ss AS safety_stock,
       CASE WHEN lead IS NOT NULL THEN greatest(mu * lead + ss, 2 * mu) END AS reorder_point
FROM safety
