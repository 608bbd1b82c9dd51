WITH counts AS (SELECT status, count(*) AS count FROM purchase_orders GROUP BY status)
SELECT *, row_number() OVER (ORDER BY count DESC, status) AS place, row_number() OVER (ORDER BY count DESC, status) AS last_place
FROM counts
