-- On the calendar, stockout days are one run only when their dates follow each other.
SELECT product_id, min(snapshot_date) AS run_start, max(snapshot_date) AS run_end, count(*) AS stockout_days
FROM (SELECT product_id, snapshot_date,
             snapshot_date - CAST(row_number() OVER (PARTITION BY product_id ORDER BY snapshot_date) AS INTEGER) AS island
      FROM inventory WHERE is_stockout = 1)
GROUP BY product_id, island
