SELECT supplier_id, count(*) AS received_orders,
       avg(CASE WHEN status = 'Delivered' AND actual_delivery_date <= expected_delivery_date THEN 1 ELSE 0 END) AS reliability_score,
       avg(date_diff('day', order_date, actual_delivery_date)) AS mean_lead_days,
       round(stddev_samp(date_diff('day', order_date, actual_delivery_date)), 6) AS std_lead_days
FROM purchase_orders WHERE actual_delivery_date IS NOT NULL GROUP BY supplier_id
