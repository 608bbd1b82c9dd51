SELECT product_id, sku, product_name, category, CAST(unit_cost AS DOUBLE) AS unit_cost,
       CAST(unit_price AS DOUBLE) AS unit_price, supplier_id, pattern_group
FROM products
