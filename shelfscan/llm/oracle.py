"""Queries of this subpackage that SQL can express, as DuckDB SQL over the driver tables."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, COUNT(*) AS c
    FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
    SELECT doc_id AS node, doc_id AS label FROM sets
    UNION
    SELECT y, label FROM reached JOIN both_ways ON node = x WHERE label < y
),
components AS (SELECT node, MIN(label) AS label FROM reached GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, label AS component_id, doc_id = label AS kept
FROM sets JOIN components ON doc_id = node
"""

ARCHIVE = """
WITH payloads AS (
    SELECT page_id, COALESCE(html, '') AS payload, strlen(COALESCE(html, '')) AS n FROM pages
),
firsts AS (
    SELECT *, CASE WHEN n >= 100 THEN MIN(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first_id FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
    CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""

REPEATS = """
WITH bytes AS (
    SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, strlen(COALESCE(text, '')) AS n FROM documents
),
numbered_parts AS (SELECT doc_id, h, unnest(range(0, (n + 499) // 500)) AS k FROM bytes),
parts AS (SELECT doc_id, 500 * k AS base, substr(h, 1000 * k + 1, 1098) AS part FROM numbered_parts),
starts AS (
    SELECT doc_id, base, part, unnest(range(0, LEAST(500, strlen(part) // 2 - 49))) AS q FROM parts
),
strings AS (SELECT doc_id, base + q AS p, hash(substr(part, 2 * q + 1, 100)) AS s FROM starts),
least AS (SELECT s, MIN(doc_id) AS first_id FROM strings GROUP BY s HAVING COUNT(*) > 1),
covered AS (
    SELECT doc_id, p, LAG(p) OVER (PARTITION BY doc_id ORDER BY p) AS before
    FROM strings JOIN least USING (s) WHERE doc_id > first_id
),
numbered AS (
    SELECT doc_id, p, SUM(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY p) AS run
    FROM covered
),
spans AS (SELECT doc_id, run, MIN(p) AS low, MAX(p) + 50 AS high FROM numbered GROUP BY doc_id, run),
pieces AS (
    SELECT doc_id, low, high, COALESCE(LAG(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS begin FROM spans
),
cut AS (
    SELECT doc_id, SUM(high - low) AS removed, COUNT(*) AS spans, MAX(high) AS rest,
        string_agg(substr(h, 2 * begin + 1, 2 * (low - begin)), '' ORDER BY low) AS front
    FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(removed, 0) AS BIGINT) AS n_removed,
    CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE front || substr(h, 2 * rest + 1) END)) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""

FAIR_MIX = r"""
WITH sized AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        substr(sha256('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(text, '')), 1, 32) AS code
    FROM documents
),
sums AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
    SELECT *, [5.0, 2.0, 1.0][CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
    FROM sums
),
by_need AS (
    SELECT *, COALESCE(SUM(2 * source_size) OVER before, 0) AS full_size, SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0) AS open_weight,
        1.5 * SUM(source_size) OVER () AS budget
    FROM weighted
    WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levels AS (SELECT *, (budget::DOUBLE - full_size::DOUBLE) / open_weight AS level FROM by_need),
found AS (SELECT arg_min(level, 2 * source_size / weight) AS level FROM levels WHERE level * weight <= 2 * source_size),
targets AS (
    SELECT source, source_size, CASE WHEN level IS NULL OR level * weight > 2 * source_size THEN (2 * source_size)::DOUBLE
        ELSE level * weight END AS target
    FROM weighted, found
),
placed AS (
    SELECT d.*, source_size, target, COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY code, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(
    GREATEST(0, LEAST(size, floor(target) - earlier)) + GREATEST(0, LEAST(size, floor(target) - source_size - earlier)) AS BIGINT) AS taken,
    source
FROM placed
"""

IMPORTANCE = r"""
WITH crc_table AS (
    SELECT list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)
),
texts AS (
    SELECT 'corpus' AS side, doc_id, row_number() OVER () AS row, text FROM documents
    UNION ALL SELECT 'target', NULL, row_number() OVER () , text FROM benchmark
),
words AS (
    SELECT side, doc_id, row, regexp_extract_all(
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
),
runs AS (
    SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
    FROM words
),
distinct_runs AS (SELECT DISTINCT f FROM runs),
hashed AS (
    SELECT f, xor(list_reduce([4294967295] || list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM distinct_runs, crc_table
),
placed AS (SELECT side, row, bucket FROM runs JOIN hashed USING (f)),
counts AS (
    SELECT bucket, COUNT(*) FILTER (side = 'corpus') AS s, COUNT(*) FILTER (side = 'target') AS t FROM placed GROUP BY bucket
),
totals AS (SELECT SUM(s) AS all_s, SUM(t) AS all_t FROM counts),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM counts, totals
),
weights AS (SELECT row, COUNT(*) AS n, SUM(gain) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'corpus' GROUP BY row),
scored AS (
    SELECT doc_id, row, len(w) AS n_words, COALESCE(n, 0) AS n_features, CAST(COALESCE(weight, 0) AS BIGINT) AS weight,
        CAST(COALESCE(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM words LEFT JOIN weights USING (row) WHERE side = 'corpus'
),
ranked AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, 5 * COUNT(*) OVER () // 100 AS drawn
    FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM scored LEFT JOIN ranked USING (row)
"""

PREFIX_TRIE = r"""
WITH crc_table AS (
    SELECT list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)
),
turns AS (
    SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
        md5(to_json([COALESCE(role, ''), COALESCE(text, '')])::VARCHAR) AS e,
        COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
        [4294967295] || list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4 AS h
    FROM turns, crc_table
),
rebuilt AS (
    SELECT i.conv_id, 0 AS side, t.pos, t.e, t.words FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos < i.h
    UNION ALL SELECT conv_id, 1, pos, e, words FROM ids JOIN turns USING (conv_id) WHERE pos >= h
),
sequences AS (
    SELECT conv_id, COALESCE(list(e ORDER BY side, pos) FILTER (e IS NOT NULL), []) AS s, list(words ORDER BY side, pos) AS w
    FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
),
prefixes AS (SELECT conv_id, s, w, unnest(range(0, len(s) + 1)) AS depth FROM sequences),
nodes AS (
    SELECT depth, array_to_string(s[1:depth], ',') AS k, COUNT(*) AS n, MIN(conv_id) AS conv_id, MIN(COALESCE(w[depth], 0)) AS words,
        sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, k
),
linked AS (SELECT *, CASE WHEN depth > 0 THEN substr(k, 1, GREATEST(33 * (depth - 1) - 1, 0)) END AS parent_k FROM nodes),
children AS (SELECT depth - 1 AS depth, parent_k AS k, COUNT(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, COALESCE(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (depth, k)),
ups AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted),
sums AS (
    SELECT up AS depth, substr(k, 1, GREATEST(33 * up - 1, 0)) AS k, COUNT(*) FILTER (n_children = 0) AS n_leaves,
        SUM((n - 1) * CASE WHEN depth > 0 THEN words ELSE 0 END) AS saved
    FROM ups GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n AS n_convs, c.n_children, n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (depth, k) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.k = c.parent_k
"""

ORACLES = {
    "op3_min_max_dedup": NEAR_DUPLICATES,
    "op8_warc": ARCHIVE,
    "op9_repeats": REPEATS,
    "op11_fair_mix": FAIR_MIX,
    "op12_importance": IMPORTANCE,
    "op13_prefix_trie": PREFIX_TRIE,
}
