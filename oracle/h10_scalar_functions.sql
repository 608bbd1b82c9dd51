SELECT s.product_id, p.sku, split_part(p.product_name, ' ', 1) AS first_word,
       strftime(s.sale_date, '%Y-%m-%d') AS iso_date,
       strftime(s.sale_date + 7, '%Y-%m-%d') AS iso_next_week,
       CAST(dayofyear(s.sale_date) AS INTEGER) AS day_of_year,
       round(sin(dayofyear(s.sale_date) * 2 * CAST(3.141592653589793 AS DOUBLE) / 7), 9) AS weekly_wave,
       sqrt(CAST(s.units_demanded AS DOUBLE)) AS root,
       least(greatest(s.units_demanded, 5), 40) AS clipped,
       CAST(round_even(CAST(s.units_demanded AS DOUBLE) / 4, 0) AS BIGINT) AS quarter_half_even,
       CASE WHEN dayofyear(s.sale_date) BETWEEN 280 AND 320 THEN s.units_demanded * CAST(1.8 AS DOUBLE)
            ELSE CAST(s.units_demanded AS DOUBLE) END AS lifted
FROM sales s JOIN products p USING (product_id)
