SELECT category, round(sum(cost), 4) AS carrying_cost
FROM (SELECT product_id, category,
             avg(stock_on_hand) * CAST(any_value(unit_cost) AS DOUBLE) * CAST(0.2 AS DOUBLE)
             * (date_diff('day', min(snapshot_date), max(snapshot_date)) + 1) / 365 AS cost
      FROM inventory JOIN products USING (product_id) GROUP BY product_id, category)
GROUP BY category
