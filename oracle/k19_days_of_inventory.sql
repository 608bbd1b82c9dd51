WITH newest AS (
    SELECT product_id, stock_on_hand FROM inventory
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY snapshot_date DESC) = 1
),
demand AS (
    SELECT product_id, avg(units_sold) AS d FROM sales
    WHERE sale_date >= (SELECT max(sale_date) - 30 FROM sales) GROUP BY product_id
),
cover AS (
    SELECT p.*, w.stock_on_hand, d.d FROM newest w JOIN products p USING (product_id) LEFT JOIN demand d USING (product_id)
)
SELECT category, CAST(sum(stock_on_hand) AS BIGINT) AS stock_on_hand, round(sum(d), 6) AS avg_daily_demand_30d,
       round(sum(stock_on_hand) / nullif(sum(d), 0), 6) AS days_of_inventory_remaining
FROM cover GROUP BY category
