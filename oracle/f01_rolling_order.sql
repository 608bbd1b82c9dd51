SELECT product_id, sale_date, row_number() OVER ordered AS place, row_number() OVER ordered AS last_place
FROM sales JOIN products USING (product_id)
WINDOW ordered AS (ORDER BY product_id, sale_date)
