SELECT s.product_id, s.product_name, s.category, s.stock_on_hand, s.reorder_point, s.status, s.supplier_id,
       CAST(COALESCE(l.revenue, 0) AS DOUBLE) AS revenue_at_risk
FROM status s LEFT JOIN lost l ON l.product_id = s.product_id
WHERE s.status IN ('🔴 Critical', '🟠 Reorder Soon')
