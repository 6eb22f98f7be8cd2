"""SQL that states the results of operators 11 to 13."""

#: gains over hashed words, one crc32 step per byte
RESAMPLED = """
WITH crc_table AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i)),
split AS (
  SELECT 'c' AS side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') FROM benchmark),
words AS (SELECT side, doc_id, unnest(w) AS word FROM split),
spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
hashed AS (
  SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM spelled, crc_table),
counts AS (SELECT bucket, CAST(count(*) FILTER (WHERE side = 'c') AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE side = 't') AS DOUBLE) AS t FROM words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS total FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'c' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(total / n_features) AS BIGINT), 0) AS weight,
    CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) AS h
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id),
noisy AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
FROM noisy y LEFT JOIN ranked r ON y.doc_id = r.doc_id
"""

#: the cheapest edits of every row between two states, and the cheapest way through them
REPAIRED = """
WITH crc_table AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i)),
original AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM original, crc_table),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM rows),
faulty AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN trimmed = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following
  FROM numbered),
gathered AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE initial || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
edits AS (
  -- from state, to state, cost, letters, the turns that the inserts and the row become
  SELECT f.conv_id, f.i, g.x, CASE WHEN letter = 'D' THEN g.y WHEN letter = 'R' THEN CASE WHEN g.y = 2 THEN 3 ELSE 2 END
      ELSE CASE WHEN f.initial = 's' AND g.y = 0 THEN 1 WHEN f.initial = 'u' AND g.y IN (0, 1, 3) THEN 2 WHEN f.initial = 'a' AND g.y = 2 THEN 3 WHEN f.initial = '' THEN g.y END END AS t,
    g.cost + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 + CAST(f.fault = 3 AS INT) ELSE CAST(f.fault = 3 AS INT) END AS cost, g.letters || letter AS letters,
    g.turns || CASE letter WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE WHEN g.y = 2 THEN 'assistant' ELSE 'user' END || ':' || f.text ELSE chr(10) || f.role || ':' || f.text END AS turns
  FROM faulty f, (VALUES ('D'), ('K'), ('R')) l(letter), (
    SELECT x, x AS y, 0 AS cost, '' AS letters, '' AS turns FROM (VALUES (0), (1), (2), (3)) s(x)
    UNION ALL SELECT x, CASE WHEN x = 2 THEN 3 ELSE 2 END, 2, 'I', chr(10) || CASE WHEN x = 2 THEN 'assistant:' ELSE 'user:' END FROM (VALUES (0), (1), (2), (3)) s(x)
    UNION ALL SELECT x, CASE WHEN x = 2 THEN 2 ELSE 3 END, 4, 'II', CASE WHEN x = 2 THEN chr(10) || 'assistant:' || chr(10) || 'user:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END FROM (VALUES (0), (1), (2), (3)) s(x)) g
  WHERE letter = 'D' OR f.fault NOT IN (1, 2)),
steps AS (SELECT conv_id, i, x, t, min({'cost': cost, 'letters': letters, 'turns': turns}) AS best FROM edits WHERE t IS NOT NULL GROUP BY conv_id, i, x, t),
ways AS (
  WITH RECURSIVE way AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': 0, 'letters': '', 'turns': ''} AS best FROM conversations
    UNION ALL
    SELECT conv_id, i, t, min({'cost': cost, 'letters': letters, 'turns': turns}) FROM (
      SELECT s.conv_id, s.i, s.t, w.best.cost + s.best.cost AS cost, w.best.letters || s.best.letters AS letters, w.best.turns || s.best.turns AS turns
      FROM way w JOIN steps s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = w.i + 1 AND s.x = w.state)
    GROUP BY conv_id, i, t)
  SELECT * FROM way),
closed AS (
  SELECT w.conv_id, min({'cost': w.best.cost + e.cost, 'audit': w.best.letters || e.letters, 'turns': w.best.turns || e.turns}) AS best
  FROM ways w JOIN (SELECT conv_id, max(i) AS n FROM ways GROUP BY conv_id) m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.i = m.n
  JOIN (VALUES (0, 0, '', ''), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) e(state, cost, letters, turns) ON e.state = w.state
  GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(c.best.cost AS BIGINT) AS cost, c.best.audit AS audit, sha256(substr(c.best.turns, 2)) AS repaired_sha256
FROM closed c LEFT JOIN gathered g ON c.conv_id IS NOT DISTINCT FROM g.conv_id
"""

#: all pairs of a label, and what they reach
LINKED = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND a.usable AND b.usable
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest w ON w.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""
