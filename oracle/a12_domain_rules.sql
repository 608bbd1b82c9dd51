WITH found AS (
    SELECT 'negative units_sold' AS rule, count(*) AS violations FROM sales WHERE units_sold < 0
    UNION ALL SELECT 'negative units_demanded', count(*) FROM sales WHERE units_demanded < 0
    UNION ALL SELECT 'units_demanded below units_sold', count(*) FROM sales WHERE units_demanded < units_sold
    UNION ALL SELECT 'sale_date out of range', count(*) FROM sales
              WHERE sale_date NOT BETWEEN DATE '2020-01-01' AND DATE '2030-01-01'
    UNION ALL SELECT 'negative stock_on_hand', count(*) FROM inventory WHERE stock_on_hand < 0
    UNION ALL SELECT 'missing category', count(*) FROM products WHERE category IS NULL
)
SELECT rule, violations,
       CASE WHEN (SELECT max(violations) FROM found) = 0 THEN 'PASS' ELSE 'ISSUES' END AS verdict
FROM found
