WITH days AS (SELECT CAST(unnest(generate_series(min(snapshot_date), max(snapshot_date), INTERVAL 1 DAY)) AS DATE) AS date FROM inventory)
SELECT d.date, dayname(d.date) AS dow, CAST(COALESCE(sum(s.units_sold), 0) AS BIGINT) AS units_sold,
       CAST(COALESCE(sum(s.units_demanded), 0) AS BIGINT) AS units_demanded
FROM days d LEFT JOIN sales s ON s.sale_date = d.date GROUP BY d.date
