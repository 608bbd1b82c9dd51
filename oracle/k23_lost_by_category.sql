SELECT category, CAST(sum(revenue) AS DOUBLE) AS revenue_lost,
       round(100.0 * CAST(sum(revenue) AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) FROM lost), 2) AS share_pct
FROM lost GROUP BY category
