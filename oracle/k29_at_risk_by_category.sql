SELECT s.category, count(*) AS products_at_risk,
       count(*) FILTER (WHERE s.status = '🔴 Critical') AS critical_products,
       CAST(COALESCE(sum(l.revenue), 0) AS DOUBLE) AS revenue_at_risk
FROM status s LEFT JOIN lost l ON l.product_id = s.product_id
WHERE s.status IN ('🔴 Critical', '🟠 Reorder Soon') GROUP BY s.category
