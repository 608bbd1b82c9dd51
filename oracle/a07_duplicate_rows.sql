SELECT 'suppliers' AS table_name, (SELECT count(*) FROM suppliers)
       - (SELECT count(*) FROM (SELECT DISTINCT * FROM suppliers)) AS duplicate_rows
UNION ALL
SELECT 'products', (SELECT count(*) FROM products) - (SELECT count(*) FROM (SELECT DISTINCT * FROM products))
UNION ALL
SELECT 'purchase_orders', (SELECT count(*) FROM purchase_orders)
       - (SELECT count(*) FROM (SELECT DISTINCT * FROM purchase_orders))
UNION ALL
SELECT 'sales', (SELECT count(*) FROM sales) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales))
UNION ALL
SELECT 'inventory', (SELECT count(*) FROM inventory)
       - (SELECT count(*) FROM (SELECT DISTINCT * FROM inventory))
UNION ALL
SELECT 'lineitem', (SELECT count(*) FROM lineitem)
       - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))
