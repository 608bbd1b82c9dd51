SELECT product_id, supplier_id, order_date, expected_delivery_date, actual_delivery_date, quantity_ordered,
       CAST(unit_cost AS DOUBLE) AS unit_cost, status
FROM purchase_orders
WHERE order_date <= DATE '1999-06-30' AND COALESCE(actual_delivery_date, DATE '9999-12-31') > DATE '1999-06-30'
  AND status <> 'Cancelled'
