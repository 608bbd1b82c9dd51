WITH days AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
grid AS (SELECT product_id, day FROM (SELECT DISTINCT product_id FROM inventory) CROSS JOIN days),
stock AS (
    SELECT g.day, count(*) AS products, sum(i.stock_on_hand) AS stock_on_hand
    FROM grid g ASOF LEFT JOIN inventory i ON i.product_id = g.product_id AND i.snapshot_date <= g.day
    GROUP BY g.day
)
SELECT k.day AS snapshot_date, k.products, CAST(k.stock_on_hand AS BIGINT) AS stock_on_hand,
       CAST(COALESCE((SELECT sum(is_stockout) FROM inventory i WHERE i.snapshot_date = k.day), 0) AS BIGINT) AS stockouts,
       CAST(COALESCE((SELECT sum(units_sold) FROM sales s WHERE s.sale_date = k.day), 0) AS BIGINT) AS units_sold,
       CAST(COALESCE((SELECT sum(units_demanded) FROM sales s WHERE s.sale_date = k.day), 0) AS BIGINT) AS units_demanded,
       CAST(COALESCE((SELECT sum(got) FROM moves m WHERE m.day = k.day), 0) AS BIGINT) AS receipts
FROM stock k
