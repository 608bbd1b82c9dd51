WITH firsts AS (
    SELECT product_id, min(sale_date) AS f,
           CAST(least(date_diff('day', min(sale_date), (SELECT max(sale_date) FROM sales)) + 1, 60) AS DOUBLE) AS n
    FROM sales GROUP BY product_id
),
parts AS (
    SELECT s.product_id, any_value(n) AS n, CAST(sum(units_demanded) AS DOUBLE) / any_value(n) AS mu,
           CAST(sum(units_demanded ** 2) AS DOUBLE) / any_value(n) AS msq
    FROM sales s JOIN firsts USING (product_id)
    WHERE s.sale_date < f + 60 GROUP BY s.product_id
)
SELECT product_id, mu AS avg_daily_demand,
       CASE WHEN msq - mu * mu <= 0 THEN 1.0 ELSE sqrt(msq - mu * mu) END AS demand_std_dev
FROM parts
