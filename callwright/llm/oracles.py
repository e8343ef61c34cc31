"""DuckDB SQL for the queries that SQL can express on the same tables."""

_SPACE = r"[\x20\x09-\x0D]"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = r"""
WITH pages_ AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         DATE '2024-01-01' + ((page_id * 37) % 730)::INTEGER AS fetched_on
  FROM pages
), named AS (
  SELECT DISTINCT 'domain' AS kind, host AS pattern FROM pages_ WHERE host IS NOT NULL
  UNION SELECT 'domain', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') FROM pages_ WHERE host IS NOT NULL
  UNION SELECT 'prefix', host || '/' || lower(string_split(path, '/')[2]) FROM pages_ WHERE host IS NOT NULL AND len(string_split(path, '/')) >= 2
), code AS (SELECT kind, pattern, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS c FROM named WHERE pattern IS NOT NULL),
spans AS (
  SELECT kind, pattern, DATE '2024-01-01' + (c % 500)::INTEGER AS valid_from, DATE '2024-01-01' + (c % 500 + 40 + c % 90)::INTEGER AS valid_to FROM code WHERE c % 3 = 0
  UNION ALL
  SELECT kind, pattern, DATE '2024-01-01' + (c % 500 + 180)::INTEGER, NULL FROM code WHERE c % 3 = 0 AND c % 2 = 0
), parts AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x != '') AS steps FROM pages_ WHERE host IS NOT NULL),
asked AS (
  SELECT page_id, url, fetched_on, 'domain' AS kind, unnest(list_transform(generate_series(1, len(labels)), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.'))) AS pattern FROM parts
  UNION ALL
  SELECT page_id, url, fetched_on, 'prefix', unnest(list_transform(generate_series(0, len(steps)), lambda i: lower(host || '/' || array_to_string(list_slice(steps, 1, i), '/')))) FROM parts
), hits AS (
  SELECT a.page_id, a.url, a.fetched_on, s.valid_from, a.kind, a.pattern,
         row_number() OVER (PARTITION BY a.page_id, a.url, a.fetched_on ORDER BY s.valid_from, a.kind, a.pattern) AS nth
  FROM asked a JOIN spans s ON a.kind = s.kind AND a.pattern = s.pattern
  WHERE s.valid_from <= a.fetched_on AND (s.valid_to IS NULL OR a.fetched_on < s.valid_to)
)
SELECT p.page_id, p.url, p.fetched_on, h.nth IS NOT NULL AS blocked, h.pattern, h.kind, h.valid_from
FROM pages_ p LEFT JOIN hits h ON h.nth = 1 AND h.page_id = p.page_id AND h.url = p.url
"""

OP6 = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keys AS (
  SELECT *, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), held AS (SELECT k, min(doc_id) AS owner FROM keys WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT keys.*, held.owner IS NOT NULL AND held.owner <> doc_id AS gone FROM keys LEFT JOIN held USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"

OP9 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS t
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13)
), owner AS (SELECT t, min(doc_id) AS o FROM win GROUP BY t HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN owner USING (t), generate_series(0, 12) AS g(j) WHERE doc_id > o),
each AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.pos) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY x, y),
links AS (
  SELECT x, y, c = sx.n AND c = sy.n AS same FROM shared JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y
  WHERE 10 * c >= 8 * (sx.n + sy.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), cls AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM sh GROUP BY doc_id),
n AS (SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN NOT same THEN h END) AS n_text_links FROM links JOIN sets ON sets.doc_id = links.y GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_text_links, 0)::BIGINT AS n_text_links
FROM cls LEFT JOIN n USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents),
long AS (SELECT r, doc_id, len(ts) AS n FROM docs WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM long),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM wanted) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, docs),
score AS (
  SELECT item_id, doc_id, r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM tf JOIN long USING (r) JOIN w USING (t) JOIN wanted USING (t), total GROUP BY item_id, doc_id, r
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""

ORACLES = {"op5_url_lists": OP5, "op6_line_dedup": OP6, "op7_topk_search": OP7, "op9_substring_dedup": OP9, "op10_jaccard_join": OP10, "op12_lexical_search": OP12}
