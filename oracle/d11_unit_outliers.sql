WITH v AS (SELECT p.pattern_group, s.units_sold AS x FROM sales s JOIN products p USING (product_id)),
q AS (SELECT pattern_group, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY pattern_group)
SELECT pattern_group, x AS units_sold, count(*) AS count
FROM v JOIN q USING (pattern_group)
WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)
GROUP BY pattern_group, x
