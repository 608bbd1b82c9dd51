WITH days AS (SELECT CAST(unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY)) AS DATE) AS date FROM sales)
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month_number,
       strftime(date, '%Y-%m-01') AS month_start, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
       CAST(isodow(date) AS INTEGER) AS weekday, dayname(date) AS dow
FROM days
