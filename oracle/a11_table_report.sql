SELECT 'suppliers' AS table_name, count(*) AS rows, count(*) * 6 - count(supplier_id) - count(supplier_name)
       - count(region) - count(avg_lead_time_days) - count(lead_time_std_dev) - count(reliability_score) AS null_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM suppliers)) AS duplicate_rows FROM suppliers
UNION ALL
SELECT 'products', count(*), count(*) * 8 - count(product_id) - count(sku) - count(product_name)
       - count(category) - count(unit_cost) - count(unit_price) - count(supplier_id) - count(pattern_group),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM products)) FROM products
UNION ALL
SELECT 'purchase_orders', count(*), count(*) * 8 - count(product_id) - count(supplier_id) - count(order_date)
       - count(expected_delivery_date) - count(actual_delivery_date) - count(quantity_ordered)
       - count(unit_cost) - count(status),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM purchase_orders)) FROM purchase_orders
UNION ALL
SELECT 'sales', count(*), count(*) * 6 - count(product_id) - count(sale_date) - count(region)
       - count(units_sold) - count(units_demanded) - count(revenue),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) FROM sales
UNION ALL
SELECT 'inventory', count(*), count(*) * 5 - count(product_id) - count(snapshot_date) - count(stock_on_hand)
       - count(is_stockout) - count(reorder_point_snapshot),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM inventory)) FROM inventory
