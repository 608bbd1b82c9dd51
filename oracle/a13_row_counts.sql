SELECT 'suppliers' AS table_name, count(*) AS rows FROM suppliers
UNION ALL SELECT 'products', count(*) FROM products
UNION ALL SELECT 'purchase_orders', count(*) FROM purchase_orders
UNION ALL SELECT 'sales', count(*) FROM sales
UNION ALL SELECT 'inventory', count(*) FROM inventory
