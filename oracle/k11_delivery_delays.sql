SELECT o.product_id, o.supplier_id, o.order_date, o.expected_delivery_date, o.actual_delivery_date,
       o.quantity_ordered, CAST(o.unit_cost AS DOUBLE) AS unit_cost, o.status,
       date_diff('day', o.order_date, o.actual_delivery_date) AS actual_lead_days,
       date_diff('day', o.expected_delivery_date, o.actual_delivery_date) AS delay_days, s.supplier_name
FROM purchase_orders o JOIN suppliers s USING (supplier_id)
WHERE o.actual_delivery_date IS NOT NULL
