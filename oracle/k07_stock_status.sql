SELECT * EXCLUDE (supplier_id, unit_cost) FROM status
