"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
low AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN low USING (k) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM hit),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7 = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, list_filter(regexp_split_to_array(ls[i], '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
t AS (SELECT doc_id, i, ws, row_number() OVER (ORDER BY doc_id, i) AS o FROM l WHERE len(ws) > 0),
d AS MATERIALIZED (SELECT ws, min(o) AS o FROM t GROUP BY ws),
v AS MATERIALIZED (
  SELECT o, len(ws) AS n, j, list_concat(ws[1:j - 1], ws[j + 1:]) AS k
  FROM (SELECT o, ws, unnest(range(1, len(ws) + 1)) AS j FROM d WHERE len(ws) >= 8)),
near AS (
  SELECT a.o FROM v a JOIN (SELECT k, n, j, min(o) AS o FROM v GROUP BY ALL) b USING (k, n, j) WHERE b.o < a.o
  UNION SELECT greatest(v.o, d.o) FROM v JOIN d ON v.k = d.ws WHERE len(d.ws) >= 8),
lost AS (
  SELECT t.o FROM t JOIN d USING (ws) WHERE d.o < t.o UNION SELECT o FROM near),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n
  FROM l LEFT JOIN t USING (doc_id, i) WHERE o IS NULL OR o NOT IN (SELECT o FROM lost) GROUP BY doc_id)
SELECT documents.doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       CAST(len(string_split(text, chr(10))) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP2 = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
"""

OP3 = """
WITH ask AS (SELECT conv_id, turn, text, coalesce(length(text), 0) AS n FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
isle AS (SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS g FROM ask),
lv AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, g ORDER BY turn) - 1 AS level FROM isle),
ans AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
c AS (
  SELECT ask.conv_id, 'call_' || ask.turn AS call_id, ask.turn AS place, lv.level, ans.turn IS NOT NULL AS answered, ans.text AS answer,
         ['reply', 'search', 'count'][ask.turn % 3 + 1] AS name,
         CASE ask.turn % 3
           WHEN 0 THEN '{' || if(ask.text IS NULL, '', '"n_chars":' || ask.n || ',"text":' || to_json(ask.text) || ',') || '"turn":' || ask.turn || '}'
           WHEN 1 THEN '{' || if(ask.text IS NULL, '', '"query":' || to_json(ask.text[1:40]) || ',') || '"top":' || if(ask.n % 5 = 0, '"many"', CAST(ask.turn + 1 AS VARCHAR)) || '}'
           ELSE if(ask.n % 7 = 0, '{}', '{"items":[' || ask.turn || ',' || ask.n || ']}') END AS arguments,
         CASE ask.turn % 3 WHEN 0 THEN if(ask.n = 0, 2, 0) WHEN 1 THEN if(ask.n = 0, 1, 0) + if(ask.n % 5 = 0 OR ask.turn + 1 > 7, 1, 0) ELSE if(ask.n % 7 = 0, 1, 0) END
         + if(ask.turn >= 2 AND two.turn IS NULL, 1, 0) AS n_errors,
         if(ask.turn >= 2, '"call_' || (ask.turn - 2) || '"', '') AS uses
  FROM ask JOIN lv ON lv.conv_id = ask.conv_id AND lv.turn = ask.turn LEFT JOIN ans ON ans.conv_id = ask.conv_id AND ans.turn = ask.turn + 1
  LEFT JOIN ask two ON two.conv_id = ask.conv_id AND two.turn = ask.turn - 2
  UNION ALL
  SELECT ask.conv_id, 'digest_' || ask.turn, ask.turn, greatest(lv.level, coalesce(l4.level, 0)) + 1, false, NULL, 'digest',
         '{"of":[' || if(ask.turn >= 4, (ask.turn - 4) || ',', '') || (ask.turn - 2) || ',' || ask.turn || ']}',
         if(l2.turn IS NULL, 1, 0) + if(ask.turn >= 4 AND l4.turn IS NULL, 1, 0),
         if(ask.turn >= 4, '"call_' || (ask.turn - 4) || '",', '') || '"call_' || (ask.turn - 2) || '","call_' || ask.turn || '"'
  FROM ask JOIN lv ON lv.conv_id = ask.conv_id AND lv.turn = ask.turn LEFT JOIN lv l2 ON l2.conv_id = ask.conv_id AND l2.turn = ask.turn - 2
  LEFT JOIN lv l4 ON l4.conv_id = ask.conv_id AND l4.turn = ask.turn - 4 WHERE ask.turn % 4 = 2),
j AS (SELECT *, '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(answer) AS VARCHAR), 'null') || ',"uses":[' || uses || ']}' AS j FROM c)
SELECT conv_id, call_id, CAST(place AS BIGINT) AS place, if(answered, 'linked', 'unanswered') AS status, CAST(level AS INTEGER) AS level, n_errors = 0 AS valid, CAST(n_errors AS INTEGER) AS n_errors, sha256(j) AS json_sha256 FROM j
UNION ALL
SELECT conv_id, 'call_' || (turn - 1), CAST(turn AS BIGINT), 'orphan', 0, false, 1, sha256('')
FROM ans WHERE NOT EXISTS (SELECT 1 FROM ask WHERE ask.conv_id = ans.conv_id AND ask.turn = ans.turn - 1)
"""
