SELECT product_id, snapshot_date, stock_on_hand, is_stockout,
       CAST(CAST(reorder_point_snapshot AS DECIMAL(10,2)) AS DOUBLE) AS reorder_point_snapshot
FROM inventory
