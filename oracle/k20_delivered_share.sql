SELECT supplier_id, count(*) FILTER (WHERE status = 'Delivered') AS delivered_orders, count(*) AS all_orders,
       avg(CASE WHEN status = 'Delivered' THEN 1 ELSE 0 END) AS on_time_delivery
FROM purchase_orders GROUP BY supplier_id
