SELECT product_id, count(*) FILTER (WHERE product_id % 50 NOT IN (7, 8, 9)) AS rows,
       count(*) FILTER (WHERE product_id % 50 IN (7, 8, 9)) AS rejected,
       CAST(sum(quantity_ordered) FILTER (WHERE product_id % 50 NOT IN (7, 8, 9)) AS BIGINT) AS units
FROM purchase_orders GROUP BY product_id
