WITH firsts AS (
    SELECT product_id, min(sale_date) AS f,
           CAST(least(date_diff('day', min(sale_date), (SELECT max(sale_date) FROM sales)) + 1, 60) AS DOUBLE) AS n
    FROM sales GROUP BY product_id
),
parts AS (
    SELECT s.product_id, CAST(sum(units_demanded) AS DOUBLE) / any_value(n) AS mu,
           CAST(sum(units_demanded ** 2) AS DOUBLE) / any_value(n) AS msq
    FROM sales s JOIN firsts USING (product_id)
    WHERE s.sale_date < f + 60 GROUP BY s.product_id
),
stats AS (SELECT product_id, mu, CASE WHEN msq - mu * mu <= 0 THEN 1.0 ELSE sqrt(msq - mu * mu) END AS sigma FROM parts),
safety AS (
    SELECT product_id, mu, sigma, lead, lead_std, CAST(1.65 AS DOUBLE) * sigma * sqrt(lead) AS ss
    FROM stats JOIN lead_times USING (product_id)
)
SELECT product_id, mu AS avg_daily_demand, sigma AS demand_std_dev, lead AS lead_time_days,
       lead_std AS lead_time_std_dev, ss AS safety_stock,
       CASE WHEN lead IS NOT NULL THEN greatest(mu * lead + ss, 2 * mu) END AS reorder_point
FROM safety
