SELECT product_id, snapshot_date, stock_on_hand, reorder_point_snapshot AS reorder_point,
       CASE WHEN stock_on_hand <= reorder_point_snapshot
             AND COALESCE(lag(stock_on_hand) OVER (PARTITION BY product_id ORDER BY snapshot_date)
                          > reorder_point_snapshot, true)
            THEN 1 ELSE 0 END AS crossed_below
FROM inventory
