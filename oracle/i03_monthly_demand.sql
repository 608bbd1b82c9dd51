SELECT strftime(sale_date, '%Y-%m') AS month, CAST(sum(units_sold) AS BIGINT) AS units_sold
FROM sales GROUP BY 1
