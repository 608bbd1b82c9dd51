SELECT r.product_id, r.day, r.wanted AS units_demanded, r.sold + r.stock AS units_available,
       r.sold AS units_sold, r.wanted - r.sold AS units_lost,
       CASE WHEN r.sold < r.wanted THEN 1 ELSE 0 END AS is_stockout,
       CAST(r.sold * p.unit_price AS DOUBLE) AS revenue
FROM replay r JOIN products p USING (product_id)
