WITH places AS (
    SELECT product_id, status, days_of_inventory_remaining,
           list_position(['🔴 Critical', '🟠 Reorder Soon', '🔵 Overstocked', '🟢 Healthy'], status) AS nr FROM status
)
SELECT product_id, status, days_of_inventory_remaining, rank() OVER ordered AS place, count(*) OVER ordered AS last_place
FROM places
WINDOW ordered AS (ORDER BY nr, days_of_inventory_remaining NULLS FIRST)
