SELECT product_id, day, wanted AS units_demanded, got AS units_received, sold AS units_sold,
       stock AS stock_on_hand, CASE WHEN sold < wanted THEN 1 ELSE 0 END AS is_stockout
FROM replay
