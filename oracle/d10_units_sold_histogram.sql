WITH ends AS (SELECT CAST(min(units_sold) AS DOUBLE) AS low, CAST(max(units_sold) AS DOUBLE) AS high FROM sales),
edges AS (SELECT low, (high - low) / 40 AS width, CAST(unnest(range(40)) AS INTEGER) AS bin FROM ends),
slots AS (SELECT CAST(least(floor((units_sold - low) / ((high - low) / 40)), 39) AS INTEGER) AS bin FROM sales, ends)
SELECT e.bin, e.low + e.bin * e.width AS bin_start, e.low + (e.bin + 1) * e.width AS bin_end,
       (SELECT count(*) FROM slots s WHERE s.bin = e.bin) AS count
FROM edges e
