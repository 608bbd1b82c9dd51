SELECT * EXCLUDE (supplier_id, unit_cost) FROM status
WHERE status IN ('🔴 Critical', '🟠 Reorder Soon') AND category IN ('SMALL', 'LARGE', 'ECONOMY')
