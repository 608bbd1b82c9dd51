SELECT product_id, sale_date, region, units_sold, units_demanded, CAST(revenue AS DOUBLE) AS revenue
FROM sales
