WITH v AS (SELECT p.pattern_group, s.units_sold AS x FROM sales s JOIN products p USING (product_id)),
q AS (SELECT pattern_group, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM v GROUP BY pattern_group),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT pattern_group, count(*) AS count, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(x) AS min, min(x) FILTER (WHERE x BETWEEN lo AND hi) AS whisker_low,
       max(x) FILTER (WHERE x BETWEEN lo AND hi) AS whisker_high, max(x) AS max,
       count(*) FILTER (WHERE x NOT BETWEEN lo AND hi) AS outliers
FROM v JOIN f USING (pattern_group) GROUP BY pattern_group
