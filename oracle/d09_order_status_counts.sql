SELECT status, count(*) AS count FROM purchase_orders GROUP BY status
