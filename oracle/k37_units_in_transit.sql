SELECT product_id, count(*) AS open_orders, CAST(sum(quantity_ordered) AS BIGINT) AS units_in_transit
FROM purchase_orders
WHERE order_date <= DATE '1999-06-30' AND COALESCE(actual_delivery_date, DATE '9999-12-31') > DATE '1999-06-30'
  AND status <> 'Cancelled'
GROUP BY product_id
