SELECT product_id, count(*) AS days, avg(units_demanded) AS mean_demand,
       round(stddev_samp(units_demanded), 6) AS std_demand,
       round(stddev_samp(units_demanded) / avg(units_demanded), 6) AS coefficient_of_variation,
       round(regr_slope(CAST(units_demanded AS DOUBLE), CAST(sale_date - DATE '1970-01-01' AS DOUBLE)), 6) AS trend_slope,
       avg(units_demanded) FILTER (WHERE isodow(sale_date) = 1) / avg(units_demanded) AS monday_index,
       avg(units_demanded) FILTER (WHERE isodow(sale_date) = 2) / avg(units_demanded) AS tuesday_index,
       avg(units_demanded) FILTER (WHERE isodow(sale_date) = 3) / avg(units_demanded) AS wednesday_index,
       avg(units_demanded) FILTER (WHERE isodow(sale_date) = 4) / avg(units_demanded) AS thursday_index,
       avg(units_demanded) FILTER (WHERE isodow(sale_date) = 5) / avg(units_demanded) AS friday_index,
       avg(units_demanded) FILTER (WHERE isodow(sale_date) = 6) / avg(units_demanded) AS saturday_index,
       avg(units_demanded) FILTER (WHERE isodow(sale_date) = 7) / avg(units_demanded) AS sunday_index
FROM sales GROUP BY product_id
