SELECT supplier_id, supplier_name, region, CAST(avg_lead_time_days AS DOUBLE) AS avg_lead_time_days,
       CAST(lead_time_std_dev AS DOUBLE) AS lead_time_std_dev,
       CAST(CAST(reliability_score AS DECIMAL(4,2)) AS DOUBLE) AS reliability_score
FROM suppliers
