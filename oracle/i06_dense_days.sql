WITH flows AS (
    SELECT i.product_id, i.snapshot_date AS day, i.stock_on_hand, i.is_stockout,
           COALESCE(s.units_sold, 0) AS sold, COALESCE(s.units_demanded, 0) AS wanted, COALESCE(m.got, 0) AS got,
           lead(i.snapshot_date) OVER (PARTITION BY i.product_id ORDER BY i.snapshot_date) AS next_day
    FROM inventory i LEFT JOIN sales s ON s.product_id = i.product_id AND s.sale_date = i.snapshot_date
    LEFT JOIN moves m ON m.product_id = i.product_id AND m.day = i.snapshot_date
),
-- Each row stands for itself and for the empty days up to the next one.
filled AS (
    SELECT CAST(unnest(generate_series(day, COALESCE(next_day - 1, day), INTERVAL 1 DAY)) AS DATE) AS snapshot_date,
           day, stock_on_hand, is_stockout, sold, wanted, got
    FROM flows
)
SELECT snapshot_date, count(*) AS products, CAST(sum(stock_on_hand) AS BIGINT) AS stock_on_hand,
       CAST(sum(CASE WHEN snapshot_date = day THEN is_stockout ELSE 0 END) AS BIGINT) AS stockouts,
       CAST(sum(CASE WHEN snapshot_date = day THEN sold ELSE 0 END) AS BIGINT) AS units_sold,
       CAST(sum(CASE WHEN snapshot_date = day THEN wanted ELSE 0 END) AS BIGINT) AS units_demanded,
       CAST(sum(CASE WHEN snapshot_date = day THEN got ELSE 0 END) AS BIGINT) AS receipts
FROM filled GROUP BY snapshot_date
