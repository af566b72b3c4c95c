"""SQL of the queries that hash with crc32, which the other engine has to build from bits."""

# the table of crc32 by the bits of a byte, then its value for a list of bytes named ``b``
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i)))"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"""

OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT conv_id, turn, role, text, {CRC} % 20 AS h FROM crc_table, (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS b
    FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER w AS place, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
noted AS (
  SELECT *, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'k' END AS fault
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM noted GROUP BY conv_id),
steps(q, r, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
names(r, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
fills(q, added, lines, p) AS (
  SELECT q, '', []::VARCHAR[], q FROM range(4) AS s(q)
  UNION ALL SELECT q, 'I', [name || ':'], p FROM steps JOIN names USING (r)
  UNION ALL SELECT a.q, 'II', [x.name || ':', y.name || ':'], b.p
  FROM steps AS a JOIN names AS x ON a.r = x.r JOIN steps AS b ON a.p = b.q JOIN names AS y ON b.r = y.r),
edits AS (
  SELECT conv_id, place, q, 3 AS cost, 'D' AS letter, []::VARCHAR[] AS lines, q AS p FROM noted, range(4) AS s(q)
  UNION ALL SELECT conv_id, place, q, (fault = 't')::INT, 'K', [role || ':' || text], p
  FROM noted JOIN steps ON initial = r WHERE fault IN ('k', 't')
  UNION ALL SELECT conv_id, place, q, 2 + (fault = 't')::INT, 'R', [name || ':' || text], p
  FROM noted, steps JOIN names USING (r) WHERE fault IN ('k', 't')),
repair AS (
  SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS s FROM counted
  UNION ALL
  SELECT conv_id, k + 1, p, min(made) FROM (
    SELECT repair.conv_id, k, edits.p, {{
        'cost': s.cost + 2 * len(added) + edits.cost, 'audit': s.audit || added || letter, 'lines': s.lines || fills.lines || edits.lines}} AS made
    FROM repair JOIN fills ON repair.q = fills.q
    JOIN edits ON edits.conv_id IS NOT DISTINCT FROM repair.conv_id AND edits.place = k + 1 AND edits.q = fills.p)
  GROUP BY conv_id, k, p),
best AS (
  SELECT repair.conv_id, min({{'cost': s.cost + 2 * len(added), 'audit': s.audit || added, 'lines': s.lines || fills.lines}}) AS s
  FROM repair JOIN fills ON repair.q = fills.q JOIN counted ON repair.conv_id IS NOT DISTINCT FROM counted.conv_id AND k = n
  WHERE fills.p IN (0, 3) GROUP BY repair.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.cost, 0)::BIGINT AS cost, coalesce(s.audit, '') AS audit,
  sha256(coalesce(array_to_string(s.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counted ON c.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
"""

OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, times, {CRC} AS h FROM crc_table, (
    SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b
    FROM runs)),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
shorter AS (
  SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM shorter AS a JOIN shorter AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter AS s JOIN words AS w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter AS s JOIN words AS w ON s.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, min({{'rank': -n, 'other': other}}) AS b
  FROM near JOIN (SELECT word AS other, n FROM words) USING (other) GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.rank >= 2 * n THEN b.other END AS form,
    CASE WHEN -b.rank >= 2 * n THEN (-b.rank)::BIGINT END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS reached, 0 AS steps FROM formed
  UNION ALL SELECT chain.word, form, steps + 1 FROM chain JOIN formed ON chain.reached = formed.word WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(reached, steps) AS root FROM chain GROUP BY word) USING (word)
"""
