SELECT status, count(*) AS products, CAST(sum(stock_on_hand * unit_cost) AS DOUBLE) AS capital_tied_up
FROM status WHERE status = '🔵 Overstocked' GROUP BY status
