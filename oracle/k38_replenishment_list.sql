WITH newest AS (
    SELECT product_id, stock_on_hand FROM inventory
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY snapshot_date DESC) = 1
),
today AS (SELECT max(snapshot_date) AS d FROM inventory),
points AS (
    SELECT product_id, mu, lead,
           greatest(mu * lead + CAST(1.65 AS DOUBLE) * sigma * sqrt(lead), 2 * mu) AS rop
    FROM history JOIN lead_times USING (product_id) WHERE lead IS NOT NULL
)
SELECT n.product_id, n.stock_on_hand, round(p.rop, 2) AS reorder_point,
       greatest(CAST(round_even(p.mu * p.lead * CAST(2.5 AS DOUBLE), 0) AS BIGINT), 20) AS order_quantity
FROM newest n JOIN points p USING (product_id)
WHERE n.stock_on_hand <= p.rop
  AND NOT EXISTS (FROM purchase_orders o, today WHERE o.product_id = n.product_id AND o.order_date <= today.d
                  AND (o.actual_delivery_date IS NULL OR o.actual_delivery_date > today.d) AND o.status <> 'Cancelled')
