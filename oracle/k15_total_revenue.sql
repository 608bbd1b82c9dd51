SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM sales
