"""DuckDB SQL for the queries that it can express.

The tokenizers, the language models, the byte windows and the phrase hierarchy have no SQL
form; their queries are held against brute force in the tests. The SQL goes its own way where
it can: the links of operator 9 come from counting shared shingles of all pairs, without any
signature, and the windows of operator 4 are compared as whole strings.
"""

from __future__ import annotations

#: The checksum goes byte by byte over the digits of the text; 3988292384 is its polynomial.
OP1 = r"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda x: list_reduce(
        list_prepend(x, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    )) AS t
),
bytes AS (
    SELECT doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(COALESCE(text, ''))) AS digits,
           octet_length(encode(COALESCE(text, ''))) AS n
    FROM documents
),
summed AS (
    SELECT doc_id, key, CAST(n + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(
            range(0, 2 * n, 2), lambda i: CAST('0x' || substr(digits, i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
    )) AS text_crc32
    FROM bytes, steps
),
nodes(path, parent, name, weight, grown) AS (
    VALUES ('r0', '', 'r0', 4.0, false), ('r1', '', 'r1', 4.0, false), ('x8', '', 'x8', 1.0, true),
           ('r0/k0', 'r0', 'k0', 2.0, false), ('r0/k1', 'r0', 'k1', 2.0, false),
           ('r1/k0', 'r1', 'k0', 2.0, false), ('r1/k1', 'r1', 'k1', 2.0, false),
           ('r0/k0/0', 'r0/k0', '0', 1.0, false), ('r0/k0/1', 'r0/k0', '1', 1.0, false),
           ('r0/k1/2', 'r0/k1', '2', 1.0, false), ('r0/k1/3', 'r0/k1', '3', 1.0, false),
           ('r1/k0/4', 'r1/k0', '4', 1.0, false), ('r1/k0/5', 'r1/k0', '5', 1.0, false),
           ('r1/k1/6', 'r1/k1', '6', 1.0, false), ('r1/k1/7', 'r1/k1', '7', 1.0, false)
),
keys AS (SELECT DISTINCT key FROM bytes),
drawn AS (
    SELECT key, path, parent, name, grown,
           ln((CAST('0x' || substr(md5(path || ':' || key), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
           / weight AS draw
    FROM keys, nodes
),
regions AS (
    SELECT key, arg_max(path, draw) FILTER (WHERE NOT grown) AS region, arg_max(path, draw) AS grown_region
    FROM drawn WHERE parent = '' GROUP BY key
),
racks AS (
    SELECT r.key, any_value(r.region) AS region, any_value(r.grown_region) AS grown_region,
           arg_max(d.path, d.draw) AS rack_path, arg_max(d.name, d.draw) AS rack
    FROM regions r JOIN drawn d ON d.key = r.key AND d.parent = r.region GROUP BY r.key
),
shards AS (
    SELECT r.key, any_value(region) AS region, any_value(rack) AS rack, any_value(grown_region) AS grown_region,
           CAST(arg_max(d.name, d.draw) AS INTEGER) AS shard
    FROM racks r JOIN drawn d ON d.key = r.key AND d.parent = r.rack_path GROUP BY r.key
)
SELECT doc_id, size, text_crc32, 'key' AS law, region, rack, shard,
       row_number() OVER (
           PARTITION BY shard
           ORDER BY CAST('0x' || substr(md5(concat_ws(':', key, size, text_crc32)), 1, 8) AS BIGINT) % 4096,
                    doc_id NULLS FIRST, size, text_crc32
       ) - 1 AS slot,
       CASE WHEN grown_region = 'x8' THEN 8 ELSE shard END AS grown_shard
FROM summed JOIN shards USING (key)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS d, doc_id,
           regexp_extract_all(COALESCE({_LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
item AS (
    SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item,
           regexp_extract_all(COALESCE({_LOWER.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS said
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT d, n, i, array_to_string(w[i : i + n - 1], ' ') AS said
    FROM (SELECT d, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes)
),
hits AS (SELECT d, n, i, item FROM places JOIN windows USING (n, said)),
covered AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS p FROM hits) GROUP BY d),
named AS (
    SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT d, item FROM hits) GROUP BY d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (d) LEFT JOIN named USING (d)
"""

#: Backslashes double, and one more stands inside each control string; marks take 23 characters.
OP5 = r"""
WITH turns AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
escaped AS (
    SELECT *, list_transform([role, text], lambda x: length(x) + length(x) - length(replace(x, '\', '')) + len(regexp_extract_all(
        x, '<\|turn\|>|<\|says\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|</?s>|\[/?INST\]|<</?SYS>>'
    ))) AS sizes
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(COALESCE(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
           AS loss_sha256,
       CAST(sum(sizes[1] + sizes[2] + 23) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP9 = rf"""
WITH RECURSIVE doc AS (
    SELECT row_number() OVER () AS d, doc_id,
           regexp_extract_all(COALESCE({_LOWER.format("text")}, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT d, array_to_string(w[i : i + 3], ' ') AS s
    FROM (SELECT d, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM doc WHERE len(w) > 0)
),
sizes AS (SELECT d, count(*) AS n FROM shingles GROUP BY d),
shared AS (
    SELECT a.d AS x, b.d AS y, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.d < b.d GROUP BY a.d, b.d
),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.d = x JOIN sizes q ON q.d = y
    WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(d, other) AS (
    SELECT x, y FROM edges
    UNION
    SELECT r.d, e.y FROM reach r JOIN edges e ON e.x = r.other
),
least AS (SELECT r.d, min(o.doc_id) AS least FROM reach r JOIN doc o ON o.d = r.other GROUP BY r.d)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(least(least, doc_id), doc_id) AS component_id,
       doc_id = COALESCE(least(least, doc_id), doc_id) AS kept
FROM doc LEFT JOIN sizes USING (d) LEFT JOIN least USING (d)
"""

#: Rounds of sharing: each caps the sources above twice their size and shares the rest anew.
OP11 = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, md5(COALESCE(text, '')) AS digest,
           CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM docs GROUP BY source
),
rounds AS (
    SELECT 0 AS round, source, source_size, weight, false AS capped, false AS changed FROM sources
    UNION ALL
    SELECT round + 1, source, source_size, weight, now, bool_or(now <> capped) OVER ()
    FROM (
        SELECT *, capped OR weight * left_over > 2 * open_weights * 2 * source_size AS now
        FROM (
            SELECT *, 3 * sum(source_size) OVER () - 2 * COALESCE(sum(2 * source_size) FILTER (WHERE capped) OVER (), 0) AS left_over,
                   COALESCE(sum(weight) FILTER (WHERE NOT capped) OVER (), 0) AS open_weights
            FROM rounds
        )
    )
    WHERE round = 0 OR changed
),
settled AS (
    SELECT *, 3 * sum(source_size) OVER () - 2 * COALESCE(sum(2 * source_size) FILTER (WHERE capped) OVER (), 0) AS left_over,
           COALESCE(sum(weight) FILTER (WHERE NOT capped) OVER (), 0) AS open_weights
    FROM rounds WHERE round = (SELECT max(round) FROM rounds)
),
targets AS (
    SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
           ELSE CAST(weight * left_over AS DOUBLE) / CAST(2 * open_weights AS DOUBLE) END AS target
    FROM settled
),
hashed AS (
    SELECT *, md5('0:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(source, '') || ':' || digest) AS h,
           length(bin(size)) * 8 + (size >> CAST(greatest(length(bin(size)) - 3, 0) AS BIGINT)) AS class
    FROM docs
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, h, doc_id NULLS FIRST, digest) - 1 AS r FROM hashed
),
rated AS (
    SELECT n.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           CAST('0x' || substr(md5('0:' || COALESCE(n.source, '')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
    FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + floor((r + 1) * (rate - floor(rate)) + u) - floor(r * (rate - floor(rate)) + u)) AS BIGINT) AS taken
FROM rated
"""

_FIELD = "COALESCE(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_FORGED = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))

#: All levels of all trees as rows; proofs come from joining each leaf's ancestors to them.
OP12 = rf"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda x: list_reduce(
        list_prepend(x, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    )) AS t
),
docs AS (
    SELECT row_number() OVER () AS d, doc_id, COALESCE('=' || lang, '') AS tree, sha256({_LEAF}) AS leaf, sha256({_FORGED}) AS forged,
           xor(4294967295, list_reduce(
               list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                   range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
           )) AS crc
    FROM documents, steps
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM docs),
nodes(tree, level, place, node) AS (
    SELECT tree, 0, place, leaf FROM placed
    UNION ALL
    SELECT tree, level + 1, place // 2, sha256(node || COALESCE(other, ''))
    FROM (
        SELECT *, lead(node) OVER (PARTITION BY tree ORDER BY place) AS other, max(place) OVER (PARTITION BY tree) AS last
        FROM nodes
    )
    WHERE place % 2 = 0 AND last > 0
),
heights AS (SELECT tree, max(level) AS height, arg_max(node, level) AS subroot FROM nodes GROUP BY tree),
subroots AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS place FROM heights),
tops(level, place, node) AS (
    SELECT 0, place, subroot FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, sha256(node || COALESCE(other, ''))
    FROM (SELECT *, lead(node) OVER (ORDER BY place) AS other, max(place) OVER () AS last FROM tops)
    WHERE place % 2 = 0 AND last > 0
),
top AS (SELECT max(level) AS height, arg_max(node, level) AS root FROM tops),
ancestors AS (
    SELECT d, p.tree, level, place >> level AS above FROM placed p JOIN heights h USING (tree), unnest(range(h.height)) AS x(level)
),
steps_up AS (
    SELECT d, a.level AS step, CASE WHEN n.node IS NULL THEN '-' WHEN a.above % 2 = 1 THEN 'L' || n.node ELSE 'R' || n.node END AS said
    FROM ancestors a LEFT JOIN nodes n ON n.tree = a.tree AND n.level = a.level AND n.place = xor(a.above, 1)
    UNION ALL
    SELECT d, s.height + x.level,
           CASE WHEN n.node IS NULL THEN '-' WHEN (s.place >> x.level) % 2 = 1 THEN 'L' || n.node ELSE 'R' || n.node END
    FROM placed p JOIN subroots s USING (tree), top, unnest(range(top.height)) AS x(level)
    LEFT JOIN tops n ON n.level = x.level AND n.place = xor(s.place >> x.level, 1)
),
paths AS (SELECT d, list(said ORDER BY step) AS path FROM steps_up GROUP BY d),
folded AS (
    SELECT placed.*, COALESCE(path, []) AS path, list_reduce(
        list_prepend(CASE WHEN crc % 7 = 0 THEN forged ELSE leaf END, COALESCE(path, [])),
        lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)
    ) AS folded_root
    FROM placed LEFT JOIN paths USING (d)
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree), top
"""

OP13 = rf"""
WITH pieces AS (
    SELECT COALESCE(lang, 'und') AS lang,
           unnest(regexp_split_to_array({_LOWER.format("COALESCE(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, unnest([1, 2, 3]) AS x(n))
),
counted AS (SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE n = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE n > 1 AND f >= 10),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest
    FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates)
),
scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
           CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = first JOIN counted y ON y.lang = c.lang AND y.phrase = rest
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
    SELECT * FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM candidates c
        WHERE c.lang = b.lang AND len(c.w) > len(string_split(b.phrase, ' ')) AND 100 * c.a >= 50 * b.a
          AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')
    )
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_hash_tree_shards": OP1,
    "op4_decontaminate": OP4,
    "op5_chat_format": OP5,
    "op9_circulant_minhash": OP9,
    "op11_mix_sources": OP11,
    "op12_merkle_manifest": OP12,
    "op13_collocations": OP13,
}
