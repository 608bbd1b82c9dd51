SELECT pattern_group, count(*) AS count FROM products GROUP BY pattern_group
