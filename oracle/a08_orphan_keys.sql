SELECT 'products.supplier_id' AS foreign_key, 'suppliers.supplier_id' AS parent_key,
       count(DISTINCT supplier_id) AS orphan_keys, count(*) AS orphan_rows
FROM products c WHERE supplier_id IS NOT NULL
  AND NOT EXISTS (FROM suppliers p WHERE p.supplier_id = c.supplier_id)
UNION ALL
SELECT 'purchase_orders.product_id', 'products.product_id', count(DISTINCT product_id), count(*)
FROM purchase_orders c WHERE product_id IS NOT NULL
  AND NOT EXISTS (FROM products p WHERE p.product_id = c.product_id)
UNION ALL
SELECT 'purchase_orders.supplier_id', 'suppliers.supplier_id', count(DISTINCT supplier_id), count(*)
FROM purchase_orders c WHERE supplier_id IS NOT NULL
  AND NOT EXISTS (FROM suppliers p WHERE p.supplier_id = c.supplier_id)
UNION ALL
SELECT 'sales.product_id', 'products.product_id', count(DISTINCT product_id), count(*)
FROM sales c WHERE product_id IS NOT NULL
  AND NOT EXISTS (FROM products p WHERE p.product_id = c.product_id)
UNION ALL
SELECT 'inventory.product_id', 'products.product_id', count(DISTINCT product_id), count(*)
FROM inventory c WHERE product_id IS NOT NULL
  AND NOT EXISTS (FROM products p WHERE p.product_id = c.product_id)
UNION ALL
SELECT 'lineitem.l_orderkey', 'orders.o_orderkey', count(DISTINCT l_orderkey), count(*)
FROM lineitem c WHERE l_orderkey IS NOT NULL
  AND NOT EXISTS (FROM orders p WHERE p.o_orderkey = c.l_orderkey)
UNION ALL
SELECT 'lineitem.l_partkey', 'part.p_partkey', count(DISTINCT l_partkey), count(*)
FROM lineitem c WHERE l_partkey IS NOT NULL
  AND NOT EXISTS (FROM part p WHERE p.p_partkey = c.l_partkey)
