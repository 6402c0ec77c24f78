"""DuckDB twins of those queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s),
c AS (SELECT s, min(doc_id) AS rep, any_value(n) AS n FROM f WHERE n > 0 GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS g FROM c),
freq AS (SELECT g, count(*) AS df FROM g GROUP BY g),
o AS (SELECT rep, n, g.g, row_number() OVER (PARTITION BY rep ORDER BY df, g.g) AS k FROM g JOIN freq USING (g)),
p AS (SELECT rep, n, g FROM o WHERE k <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
sim AS (SELECT cand.a, cand.b, len(list_intersect(x.s, y.s)) AS i, na, nb FROM cand JOIN c x ON x.rep = cand.a JOIN c y ON y.rep = cand.b),
e AS (SELECT a, b FROM sim WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS id, rep AS root FROM c UNION SELECT both_ways.b, r.root FROM r JOIN both_ways ON both_ways.a = r.id WHERE r.root < both_ways.b),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_shingles, coalesce(m.component_id, f.doc_id) AS component_id, f.doc_id = coalesce(m.component_id, f.doc_id) AS kept
FROM f LEFT JOIN c ON f.n > 0 AND c.s = f.s LEFT JOIN m ON m.id = c.rep
"""

SQL["op4_decontaminate"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k AS size, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
ds AS (SELECT DISTINCT doc_id, k AS size, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bw))),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (size, s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_shared, CAST(k AS DOUBLE) / CAST(n AS DOUBLE) AS containment
FROM x JOIN bn USING (item_id) WHERE 100 * k >= 80 * n
"""

SQL["op9_topk"] = r"""
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL["op10_url_filter"] = r"""
WITH rules(h, p, v, named) AS (VALUES ('com', '/en/', 'block', true), ('example.com', '/en/7', 'allow', true), ('net', '/de/', 'block', true), ('example.net', '/de/8', 'block', true), ('org', '/es/', 'block', true),
  ('casino-win.example.org', '', 'block', false), ('spam-farm.example.org', '', 'block', false)),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, h || p AS rule, v, named FROM x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
b AS (SELECT page_id, arg_max(rule, length(rule)) FILTER (named) AS rule, arg_max(v, length(rule)) FILTER (named) AS v, max(v) FILTER (NOT named) AS l FROM f GROUP BY page_id)
SELECT x.page_id, host, path, b.rule, coalesce(b.v, b.l, 'allow') AS verdict FROM x LEFT JOIN b USING (page_id)
"""

SQL["op2_warc"] = r"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::INTEGER, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM p JOIN m USING (h)
"""

SQL["op7_shard"] = r"""
WITH tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(len(h) // 2)]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM d, tab),
s AS (SELECT *, sum(size) OVER o AS e, row_number() OVER o - 1 AS at_row, sum(size) OVER () AS total FROM b WINDOW o AS (ORDER BY doc_id, crc, size)),
p AS (SELECT *, least(23, (2 * e - size) * 24 // (2 * total)) AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, at_row - min(at_row) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM p
"""
