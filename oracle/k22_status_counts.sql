SELECT status, count(*) AS products FROM status GROUP BY status
