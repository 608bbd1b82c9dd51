WITH days AS (SELECT DISTINCT sale_date, CAST(isodow(sale_date) AS INTEGER) AS nr, dayname(sale_date) AS dow FROM sales)
SELECT dow, count(*) AS count, row_number() OVER (ORDER BY nr) AS place, row_number() OVER (ORDER BY nr) AS last_place
FROM days GROUP BY nr, dow
