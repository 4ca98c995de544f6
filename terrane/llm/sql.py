"""DuckDB SQL for the queries that SQL can express in reasonable time on whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 2) - 1], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k) WHERE len(w) > 0),
p AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
hit AS (SELECT doc_id, k, n, item FROM p JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
c AS (SELECT page_id, string_agg(concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v // 32768 % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v // 1024 % 32 + 1, 1),
 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v // 32 % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '' ORDER BY i) AS digest
 FROM (SELECT page_id, i, CAST(concat('0x', substr(h, CAST(i * 5 + 1 AS BIGINT), 5)) AS BIGINT) AS v FROM p, range(8) t(i)) GROUP BY page_id)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN m USING (html) JOIN c USING (page_id)
"""

#: crc32 of texts: a table of 256 remainders, then a step for each byte of UTF-8.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY k) AS t FROM (SELECT unnest(range(256)) AS k))"


def _crc(text: str) -> str:
    data = f"list_transform(range(strlen({text})), lambda i: CAST(concat('0x', substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


CONVERSATIONS = rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
k AS (SELECT *, {_crc("name")} % 20 AS k FROM o, crc),
a AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM k, LATERAL (SELECT unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END))) WHERE k <> 0),
b AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) AS again, concat(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY j), role[1]) AS pair
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM a)),
r AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM b),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
 count(*) FILTER (j > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
nxt(a, b, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins(a, m, c, s, put) AS (SELECT a, a, 0, '', '' FROM nxt UNION ALL SELECT a, b, 3, 'I', concat(chr(10), role, ':') FROM nxt UNION ALL SELECT x.a, y.b, 6, 'II', concat(chr(10), x.role, ':', chr(10), y.role, ':') FROM nxt x JOIN nxt y ON x.b = y.a),
kept(m, i, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edit(m, i, b, c, s, role) AS (SELECT a, '', a, 4, 'D', CAST(NULL AS VARCHAR) FROM nxt UNION ALL SELECT m, i, b, 0, 'K', CAST(NULL AS VARCHAR) FROM kept UNION ALL SELECT a, '', b, 3, 'R', role FROM nxt),
way(conv_id, j, state, cost, audit, told) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', '' FROM n UNION ALL
 SELECT conv_id, j, state, cost, audit, told FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, j, state ORDER BY cost, audit) AS best FROM (
  SELECT r.conv_id, r.j, e.b AS state, w.cost + i.c + e.c + CASE WHEN r.fault = 't' AND e.s <> 'D' THEN 3 ELSE 0 END AS cost, concat(w.audit, i.s, e.s) AS audit,
   concat(w.told, i.put, CASE WHEN e.s = 'D' THEN '' ELSE concat(chr(10), coalesce(e.role, r.role), ':', r.text) END) AS told
  FROM way w JOIN r ON r.conv_id = w.conv_id AND r.j = w.j + 1 JOIN ins i ON i.a = w.state JOIN edit e ON e.m = i.m AND (e.i = '' OR e.i = r.role[1]) AND (e.s = 'D' OR r.fault NOT IN ('b', 'd')))) WHERE best = 1),
done AS (SELECT conv_id, cost, audit, told, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM (
 SELECT w.conv_id, w.cost + i.c AS cost, concat(w.audit, i.s) AS audit, concat(w.told, i.put) AS told FROM way w JOIN n ON n.conv_id = w.conv_id AND n.n = w.j JOIN ins i ON i.a = w.state AND i.m IN (0, 3)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(d.cost, 0) AS cost, coalesce(d.audit, '') AS audit,
 sha256(substr(coalesce(d.told, ''), 2)) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id) LEFT JOIN done d ON d.conv_id = c.conv_id AND d.best = 1
"""

IMPORTANCE = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS w FROM d),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM f) + CAST(10000 AS DOUBLE)) / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM b) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
x AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM y),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM q
"""
