WITH v AS (SELECT sale_date, CAST(sum(units_sold) AS BIGINT) AS x FROM sales GROUP BY sale_date),
d AS (SELECT CAST(isodow(sale_date) AS INTEGER) AS weekday, dayname(sale_date) AS dow, x FROM v),
f AS (SELECT weekday, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM d GROUP BY weekday),
g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)
SELECT weekday, dow, count(*) AS count, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(x) AS min, min(x) FILTER (WHERE x BETWEEN lo AND hi) AS whisker_low,
       max(x) FILTER (WHERE x BETWEEN lo AND hi) AS whisker_high, max(x) AS max,
       count(*) FILTER (WHERE x NOT BETWEEN lo AND hi) AS outliers
FROM d JOIN g USING (weekday) GROUP BY weekday, dow
