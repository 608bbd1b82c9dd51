SELECT sale_date, CAST(sum(units_sold) AS BIGINT) AS units_sold, dayname(sale_date) AS dow,
       strftime(sale_date, '%Y-%m') AS month
FROM sales GROUP BY sale_date
