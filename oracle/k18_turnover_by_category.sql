WITH r AS (SELECT category, CAST(sum(revenue) AS DOUBLE) AS v FROM sales JOIN products USING (product_id) GROUP BY 1),
i AS (SELECT category, avg(stock_on_hand) AS v FROM inventory JOIN products USING (product_id) GROUP BY 1),
c AS (SELECT category, CAST(sum(unit_cost) AS DOUBLE) / count(unit_cost) AS v FROM products GROUP BY 1)
SELECT category, r.v AS total_revenue, i.v AS avg_stock_on_hand, c.v AS avg_unit_cost,
       r.v / (i.v * c.v) AS inventory_turnover
FROM r JOIN i USING (category) JOIN c USING (category)
