WITH runs AS (
    SELECT product_id, min(snapshot_date) AS run_start, max(snapshot_date) AS run_end, count(*) AS stockout_days
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY snapshot_date)
                    - row_number() OVER (PARTITION BY product_id, is_stockout ORDER BY snapshot_date) AS island
          FROM inventory)
    WHERE is_stockout = 1 GROUP BY product_id, island
)
SELECT category, count(*) AS stockout_runs, CAST(sum(stockout_days) AS BIGINT) AS stockout_days,
       avg(stockout_days) AS avg_run_days, max(stockout_days) AS longest_run_days
FROM runs JOIN products USING (product_id) GROUP BY category
