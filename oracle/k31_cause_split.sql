WITH received AS (
    SELECT supplier_id, CASE WHEN status = 'Delivered' AND actual_delivery_date <= expected_delivery_date
                             THEN 1 ELSE 0 END AS on_time
    FROM purchase_orders WHERE actual_delivery_date IS NOT NULL
),
late AS (SELECT supplier_id FROM received GROUP BY supplier_id HAVING avg(on_time) < (SELECT avg(on_time) FROM received)),
risk AS (
    SELECT product_id, product_name, status, supplier_id,
           CASE WHEN product_id IN (SELECT product_id FROM growth) THEN 1 ELSE 0 END AS demand_driven,
           CASE WHEN supplier_id IN (SELECT supplier_id FROM late) THEN 1 ELSE 0 END AS supply_driven
    FROM status WHERE status IN ('🔴 Critical', '🟠 Reorder Soon')
)
SELECT *, CASE demand_driven * 2 + supply_driven WHEN 3 THEN 'demand and supply' WHEN 2 THEN 'demand'
               WHEN 1 THEN 'supply' ELSE 'unexplained' END AS cause
FROM risk
