WITH RECURSIVE
supply AS (
    SELECT l.l_partkey AS product_id, l.l_suppkey AS supplier_id,
           CAST(l.l_quantity AS BIGINT) AS units, CAST(l.l_shipdate AS DATE) AS ship,
           CAST(o.o_orderdate AS DATE) AS ordered,
           COALESCE(o.o_orderstatus = 'P' AND l.l_returnflag = 'N', false) AS moving
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    WHERE l.l_linestatus = 'F'
),
main_supplier AS (
    SELECT l_partkey AS product_id, l_suppkey AS supplier_id
    FROM lineitem WHERE l_linestatus = 'F'
    GROUP BY l_partkey, l_suppkey
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) = 1
),
priced AS (
    SELECT p_partkey AS product_id, printf('SKU-%04d', p_partkey) AS sku, p_name AS product_name,
           p_type AS category, p_brand AS pattern_group,
           CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
           CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.7 AS DECIMAL(2,1)) AS DECIMAL(10,2)) AS unit_cost,
           p_size * 2 AS opening
    FROM part
),
products AS (
    SELECT p.product_id, p.sku, p.product_name, p.category, p.unit_cost, p.unit_price,
           p.pattern_group, m.supplier_id
    FROM priced p LEFT JOIN main_supplier m USING (product_id)
),
purchase_orders AS (
    SELECT d.product_id, d.supplier_id, d.order_date,
           d.order_date + CAST(8 + d.supplier_id % 15 AS INTEGER) AS expected_delivery_date,
           CASE WHEN NOT d.moving THEN d.ship END AS actual_delivery_date,
           d.units AS quantity_ordered, p.unit_cost,
           CASE WHEN d.moving THEN 'In Transit'
                WHEN d.ship <= d.order_date + CAST(8 + d.supplier_id % 15 AS INTEGER) THEN 'Delivered'
                ELSE 'Delayed' END AS status
    FROM (SELECT *, ship - CAST(1 + abs(date_diff('day', ordered, ship)) % 30 AS INTEGER) AS order_date
          FROM supply) d
    JOIN priced p ON p.product_id = d.product_id
),
suppliers AS (
    SELECT s.s_suppkey AS supplier_id, s.s_name AS supplier_name, r.r_name AS region,
           CAST(8 + s.s_suppkey % 15 AS DECIMAL(5,2)) AS avg_lead_time_days,
           CAST(1 + s.s_suppkey % 5 AS DECIMAL(5,2)) AS lead_time_std_dev,
           COALESCE(k.score, 0.0) AS reliability_score
    FROM supplier s
    JOIN nation n ON n.n_nationkey = s.s_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey
    LEFT JOIN (SELECT supplier_id,
                      CAST(count(*) FILTER (WHERE status = 'Delivered') AS DOUBLE)
                      / nullif(count(actual_delivery_date), 0) AS score
               FROM purchase_orders GROUP BY supplier_id) k ON k.supplier_id = s.s_suppkey
),
moves AS (
    SELECT product_id, day, CAST(sum(wanted) AS BIGINT) AS wanted, CAST(sum(got) AS BIGINT) AS got
    FROM (SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS day,
                 CAST(l_quantity AS BIGINT) AS wanted, 0 AS got
          FROM lineitem WHERE l_linestatus = 'O'
          UNION ALL
          SELECT product_id, ship, 0, units FROM supply WHERE NOT moving)
    GROUP BY product_id, day
),
steps AS (
    SELECT m.*, p.opening, row_number() OVER (PARTITION BY m.product_id ORDER BY m.day) AS step
    FROM moves m JOIN priced p USING (product_id)
),
-- The stock is replayed day by day, not by the closed form the Spark side uses.
replay AS (
    SELECT product_id, day, step, wanted, got, least(wanted, opening + got) AS sold,
           opening + got - least(wanted, opening + got) AS stock
    FROM steps WHERE step = 1
    UNION ALL
    SELECT s.product_id, s.day, s.step, s.wanted, s.got, least(s.wanted, r.stock + s.got),
           r.stock + s.got - least(s.wanted, r.stock + s.got)
    FROM replay r JOIN steps s ON s.product_id = r.product_id AND s.step = r.step + 1
),
sales AS (
    SELECT r.product_id, r.day AS sale_date, g.r_name AS region, r.sold AS units_sold,
           r.wanted AS units_demanded,
           CAST(r.sold * p.unit_price AS DECIMAL(18,2)) AS revenue
    FROM replay r JOIN priced p USING (product_id)
    LEFT JOIN region g ON g.r_regionkey = r.product_id % 5
    WHERE r.wanted > 0
),
lead_times AS (
    SELECT p.product_id, CAST(s.avg_lead_time_days AS DOUBLE) AS lead,
           CAST(s.lead_time_std_dev AS DOUBLE) AS lead_std
    FROM products p LEFT JOIN suppliers s USING (supplier_id)
),
history AS (
    SELECT product_id, total / n AS mu,
           CASE WHEN greatest(squares / n - (total / n) * (total / n), 0.0) = 0 THEN 1.0
                ELSE sqrt(greatest(squares / n - (total / n) * (total / n), 0.0)) END AS sigma
    FROM (SELECT product_id, CAST(sum(units_demanded) AS DOUBLE) AS total,
                 CAST(sum(units_demanded * units_demanded) AS DOUBLE) AS squares,
                 CAST((SELECT date_diff('day', min(sale_date), max(sale_date)) + 1 FROM sales) AS DOUBLE) AS n
          FROM sales GROUP BY product_id)
),
inventory AS (
    SELECT r.product_id, r.day AS snapshot_date, r.stock AS stock_on_hand,
           CASE WHEN r.sold < r.wanted THEN 1 ELSE 0 END AS is_stockout,
           CASE WHEN t.lead IS NOT NULL
                THEN greatest(h.mu * t.lead + CAST(1.65 AS DOUBLE) * h.sigma * sqrt(t.lead), h.mu * 2)
           END AS reorder_point_snapshot
    FROM replay r
    LEFT JOIN history h USING (product_id)
    LEFT JOIN lead_times t USING (product_id)
),
newest AS (
    SELECT product_id, stock_on_hand, reorder_point_snapshot AS rop FROM inventory
    QUALIFY snapshot_date = max(snapshot_date) OVER (PARTITION BY product_id)
),
demand AS (
    SELECT product_id, avg(units_sold) AS d FROM sales
    WHERE sale_date >= (SELECT max(sale_date) FROM sales) - 30 GROUP BY product_id
),
short AS (
    SELECT product_id, sum(is_stockout) AS n FROM inventory
    WHERE snapshot_date >= (SELECT max(snapshot_date) FROM inventory) - 30 GROUP BY product_id
),
status AS (
    SELECT p.product_id, p.product_name, p.category, p.pattern_group, p.supplier_id, p.unit_cost,
           w.stock_on_hand, round(w.rop, 1) AS reorder_point, round(d.d, 2) AS avg_daily_demand_30d,
           CAST(COALESCE(s.n, 0) AS BIGINT) AS stockout_days_last_30d,
           round(w.stock_on_hand / nullif(d.d, 0), 1) AS days_of_inventory_remaining,
           CASE WHEN w.stock_on_hand <= w.rop AND s.n > 0 THEN '🔴 Critical'
                WHEN w.stock_on_hand <= w.rop * CAST(1.2 AS DOUBLE) THEN '🟠 Reorder Soon'
                WHEN w.stock_on_hand > 3 * w.rop AND d.d < (SELECT avg(units_sold) FROM sales) THEN '🔵 Overstocked'
                ELSE '🟢 Healthy' END AS status
    FROM newest w JOIN products p USING (product_id)
    LEFT JOIN demand d USING (product_id) LEFT JOIN short s USING (product_id)
),
summary AS (
    SELECT p.product_id, p.product_name, p.category, p.pattern_group, p.supplier_id,
           CAST(sum(i.is_stockout) AS BIGINT) AS total_stockout_days, count(*) AS days_tracked,
           CAST(sum(s.units_demanded - s.units_sold) FILTER (WHERE i.is_stockout = 1) AS BIGINT) AS gap,
           any_value(p.unit_price) AS price
    FROM inventory i JOIN sales s ON s.product_id = i.product_id AND s.sale_date = i.snapshot_date
    JOIN products p ON p.product_id = i.product_id
    GROUP BY ALL
),
lost AS (
    SELECT product_id, product_name, category, pattern_group, supplier_id, total_stockout_days, days_tracked,
           round(100.0 * total_stockout_days / days_tracked, 2) AS stockout_rate_pct,
           COALESCE(gap, 0) AS total_units_lost, COALESCE(gap, 0) * price AS revenue
    FROM summary
),
monthly AS (
    SELECT product_id, date_trunc('month', sale_date) AS m, sum(units_sold) AS units FROM sales GROUP BY ALL
),
compared AS (
    SELECT *, units > lag(units, 1, units) OVER (PARTITION BY product_id ORDER BY m) AS rose FROM monthly
),
-- Every month without a rise starts a streak, which the rises after it make longer.
streaks AS (
    SELECT *, count(*) FILTER (WHERE NOT rose) OVER (PARTITION BY product_id ORDER BY m) AS streak FROM compared
),
growth AS (
    SELECT product_id, count(*) - 1 AS consecutive_growth_months,
           strftime(min(m) FILTER (WHERE rose), '%Y-%m-01') AS streak_start, strftime(max(m), '%Y-%m-01') AS streak_end
    FROM streaks GROUP BY product_id, streak HAVING count(*) > 4
)
