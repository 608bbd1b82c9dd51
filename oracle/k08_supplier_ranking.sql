WITH orders_of AS (
    SELECT supplier_id, count(*) AS total_orders,
           count(*) FILTER (WHERE status = 'Delivered' AND actual_delivery_date <= expected_delivery_date) AS on_time_orders,
           count(*) FILTER (WHERE status = 'Delayed') AS delayed_orders,
           avg(date_diff('day', order_date, actual_delivery_date)) AS lead
    FROM purchase_orders WHERE actual_delivery_date IS NOT NULL GROUP BY supplier_id
),
shortages AS (
    SELECT p.supplier_id, avg(i.is_stockout) AS rate
    FROM inventory i JOIN products p USING (product_id) GROUP BY p.supplier_id
),
performance AS (
    SELECT s.*, o.* EXCLUDE (supplier_id), h.rate, 100.0 * o.on_time_orders / o.total_orders AS pct
    FROM suppliers s JOIN orders_of o USING (supplier_id) JOIN shortages h USING (supplier_id)
)
SELECT supplier_id, supplier_name, region, CAST(avg_lead_time_days AS DOUBLE) AS quoted_avg_lead_time,
       round(lead, 1) AS actual_avg_lead_time, total_orders, on_time_orders, delayed_orders,
       round(pct, 1) AS on_time_pct, round(100.0 * delayed_orders / total_orders, 1) AS delay_pct,
       round(100.0 * rate, 1) AS stockout_rate_pct_of_products_supplied,
       rank() OVER (ORDER BY pct DESC) AS on_time_rank
FROM performance
