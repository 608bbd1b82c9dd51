SELECT l_orderkey, l_linenumber, count(*) AS count
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
