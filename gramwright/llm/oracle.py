"""SQL for DuckDB, of the operators that SQL can express on whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) p
), sizes AS (
  SELECT doc_id, count(k) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
), sym AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r
)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id
"""

BENCHMARK = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT item_id, least(8, len(w)) AS n, array_to_string(list_slice(w, s, s + least(8, len(w)) - 1), ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0) p
), dwin AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) z WHERE len(w) >= n) p
), hits AS (
  SELECT DISTINCT doc_id, s, dwin.n AS n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.k = win.k
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) q GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) q GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
