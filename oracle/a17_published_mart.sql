SELECT strftime(sale_date, '%Y-%m') AS month, count(*) AS rows,
       CAST(sum(units_sold) AS BIGINT) AS units_sold, count(*) AS stamped
FROM sales GROUP BY 1
