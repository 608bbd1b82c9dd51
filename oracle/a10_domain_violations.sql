SELECT 'suppliers' AS table_name, u.rule, u.violations FROM (
    SELECT count(*) - count(supplier_id) AS "supplier_id is required",
           count(*) - count(supplier_name) AS "supplier_name is required",
           count(*) - count(region) AS "region is required",
           count(*) - count(avg_lead_time_days) AS "avg_lead_time_days is required",
           count(*) - count(lead_time_std_dev) AS "lead_time_std_dev is required",
           count(*) - count(reliability_score) AS "reliability_score is required" FROM suppliers
) UNPIVOT (violations FOR rule IN (COLUMNS(*))) u
UNION ALL
SELECT 'products', u.rule, u.violations FROM (
    SELECT count(*) - count(product_id) AS "product_id is required", count(*) - count(sku) AS "sku is required",
           count(*) - count(product_name) AS "product_name is required",
           count(*) - count(category) AS "category is required",
           count(*) - count(unit_cost) AS "unit_cost is required",
           count(*) - count(unit_price) AS "unit_price is required",
           count(*) - count(supplier_id) AS "supplier_id is required",
           count(*) - count(pattern_group) AS "pattern_group is required" FROM products
) UNPIVOT (violations FOR rule IN (COLUMNS(*))) u
UNION ALL
SELECT 'purchase_orders', u.rule, u.violations FROM (
    SELECT count(*) - count(product_id) AS "product_id is required",
           count(*) - count(supplier_id) AS "supplier_id is required",
           count(*) - count(order_date) AS "order_date is required",
           count(*) - count(expected_delivery_date) AS "expected_delivery_date is required",
           count(*) - count(quantity_ordered) AS "quantity_ordered is required",
           count(*) - count(unit_cost) AS "unit_cost is required",
           count(*) - count(status) AS "status is required",
           count(*) FILTER (WHERE status NOT IN ('Delivered', 'Delayed', 'In Transit', 'Cancelled')) AS "status is listed"
    FROM purchase_orders
) UNPIVOT (violations FOR rule IN (COLUMNS(*))) u
UNION ALL
SELECT 'purchase_orders', 'po_id is missing', 1
UNION ALL
SELECT 'sales', u.rule, u.violations FROM (
    SELECT count(*) - count(product_id) AS "product_id is required",
           count(*) - count(sale_date) AS "sale_date is required",
           count(*) - count(region) AS "region is required",
           count(*) - count(units_sold) AS "units_sold is required",
           count(*) - count(units_demanded) AS "units_demanded is required",
           count(*) - count(revenue) AS "revenue is required" FROM sales
) UNPIVOT (violations FOR rule IN (COLUMNS(*))) u
UNION ALL
SELECT 'inventory', u.rule, u.violations FROM (
    SELECT count(*) - count(product_id) AS "product_id is required",
           count(*) - count(snapshot_date) AS "snapshot_date is required",
           count(*) - count(stock_on_hand) AS "stock_on_hand is required",
           count(*) - count(is_stockout) AS "is_stockout is required" FROM inventory
) UNPIVOT (violations FOR rule IN (COLUMNS(*))) u
