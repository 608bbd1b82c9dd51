WITH top AS (
    SELECT product_id, category, rank() OVER (PARTITION BY category ORDER BY total_stockout_days DESC) AS rank_in_category
    FROM lost QUALIFY rank_in_category <= 5
)
SELECT *, rank() OVER (ORDER BY category, rank_in_category) AS place,
       count(*) OVER (ORDER BY category, rank_in_category) AS last_place
FROM top
