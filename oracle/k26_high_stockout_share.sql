SELECT count(*) FILTER (WHERE 20 * total_stockout_days > days_tracked) AS products_above, count(*) AS products,
       round(100.0 * count(*) FILTER (WHERE 20 * total_stockout_days > days_tracked) / count(*), 2) AS share_pct
FROM lost
