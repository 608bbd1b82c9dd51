WITH v AS (
    SELECT pattern_group, avg(units_demanded) FILTER (WHERE dayofyear(sale_date) BETWEEN 280 AND 320) AS festive,
           avg(units_demanded) FILTER (WHERE dayofyear(sale_date) NOT BETWEEN 280 AND 320) AS other
    FROM sales JOIN products USING (product_id) GROUP BY pattern_group
)
SELECT pattern_group, festive AS festive_avg_demand, other AS other_avg_demand, festive / nullif(other, 0) AS festive_uplift
FROM v
