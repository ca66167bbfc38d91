"""Independent SQL for the numbered queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES["op1_decontamination"] = rf"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS win
  FROM item_words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, w[i:i + n - 1] AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, sizes WHERE len(w) >= n)
), hits AS (
  SELECT d.r, d.i, d.n, b.item FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win
), hit_words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

ORACLES["op3_repeated_passages"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT r, doc_id, i, w[i:i + 12] AS win
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), marked AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM windows) WHERE first < doc_id
), gone AS (
  SELECT r, list(DISTINCT k) AS ks FROM (SELECT r, unnest(generate_series(i, i + 12)) AS k FROM marked) GROUP BY r
), kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(ks), 0) AS n_removed,
         list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(coalesce(ks, []), i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS k
  FROM words LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

ORACLES["op9_exact_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.r AS q, q.vec_id AS query_id, v.vec_id, v.r, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id, score
  FROM scores
)
SELECT * FROM ranked WHERE rank <= 20
"""

ORACLES["op10_near_duplicates"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
    list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN generate_series(1, greatest(len(w) - 3, 1))]) END AS s
  FROM words
), items AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs WHERE 100 * n_both >= 80 * (na + nb - n_both)),
reach AS (
  SELECT doc_id AS root, doc_id FROM sets UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.doc_id
), component AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN component USING (doc_id)
"""

ORACLES["op11_prefix_trie"] = """
WITH crc AS (
  SELECT list_transform(range(256), lambda x:
    list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), rows AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS turns
  FROM rows GROUP BY c
), heads AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, crc
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 5
), paths AS (
  SELECT c, turns[1:d] AS path, d, d = len(turns) AS ends FROM (SELECT c, turns, unnest(generate_series(0, len(turns))) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS e
  FROM paths GROUP BY path, d
), kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.path[n.d].text) END AS saved
  FROM nodes n LEFT JOIN kids USING (path, d)
), above AS (
  SELECT path[1:a] AS path, a AS d, saved, k FROM (SELECT path, saved, k, unnest(generate_series(0, d)) AS a FROM full_nodes)
), sums AS (SELECT path, d, sum(saved) AS saved, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves FROM above GROUP BY path, d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(n.k AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.e, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path AND s.d = n.d LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
