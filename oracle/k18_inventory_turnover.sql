SELECT r.v AS total_revenue, i.v AS avg_stock_on_hand, c.v AS avg_unit_cost, r.v / (i.v * c.v) AS inventory_turnover
FROM (SELECT CAST(sum(revenue) AS DOUBLE) AS v FROM sales) r,
     (SELECT avg(stock_on_hand) AS v FROM inventory) i,
     (SELECT CAST(sum(unit_cost) AS DOUBLE) / count(unit_cost) AS v FROM products) c
