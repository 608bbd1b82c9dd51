SELECT row_number() OVER (ORDER BY product_id, order_date, supplier_id,
           expected_delivery_date, actual_delivery_date NULLS FIRST, quantity_ordered, status) AS po_id,
       product_id, supplier_id, order_date, expected_delivery_date, actual_delivery_date,
       quantity_ordered, CAST(unit_cost AS DOUBLE) AS unit_cost, status
FROM purchase_orders
