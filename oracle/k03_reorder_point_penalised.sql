WITH slow AS (
    SELECT product_id, lead * f AS lead, lead_std * f AS lead_std
    FROM lead_times
    JOIN (SELECT product_id, CAST(CASE WHEN category = 'ECONOMY' THEN 1.6 ELSE 1.0 END AS DOUBLE) AS f FROM products)
    USING (product_id)
),
safety AS (SELECT *, CAST(1.65 AS DOUBLE) * sigma * sqrt(lead) AS ss FROM history JOIN slow USING (product_id))
SELECT product_id, mu AS avg_daily_demand, sigma AS demand_std_dev, lead AS lead_time_days,
       lead_std AS lead_time_std_dev, ss AS safety_stock,
       CASE WHEN lead IS NOT NULL THEN greatest(mu * lead + ss, 2 * mu) END AS reorder_point
FROM safety
