WITH worst AS (
    SELECT product_id FROM inventory GROUP BY product_id ORDER BY sum(is_stockout) DESC, product_id LIMIT 1
),
stock AS (
    SELECT product_id, snapshot_date, stock_on_hand, is_stockout, reorder_point_snapshot AS rop,
           lag(stock_on_hand) OVER (ORDER BY snapshot_date) > reorder_point_snapshot AS was_above
    FROM inventory WHERE product_id = (SELECT product_id FROM worst)
),
demand AS (
    SELECT sale_date, units_sold, units_demanded, avg(units_sold) OVER w AS a, CAST(sum(units_sold) OVER w AS BIGINT) AS t
    FROM sales WHERE product_id = (SELECT product_id FROM worst)
    WINDOW w AS (ORDER BY sale_date ROWS 29 PRECEDING)
)
SELECT s.product_id, s.snapshot_date, s.stock_on_hand, s.rop AS reorder_point,
       CASE WHEN s.stock_on_hand <= s.rop AND COALESCE(s.was_above, true) THEN 1 ELSE 0 END AS crossed_below,
       d.units_sold, round(d.a, 2) AS rolling_30d_avg_demand, d.t AS rolling_30d_total_demand,
       s.is_stockout, CAST(l.units AS BIGINT) AS units_lost,
       CAST(l.units * p.unit_price AS DOUBLE) AS estimated_revenue_lost
FROM stock s LEFT JOIN demand d ON d.sale_date = s.snapshot_date
LEFT JOIN products p ON p.product_id = s.product_id,
LATERAL (SELECT CASE WHEN s.is_stockout = 1 THEN COALESCE(d.units_demanded - d.units_sold, 0) ELSE 0 END AS units) l
