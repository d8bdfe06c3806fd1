"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM w
),
sizes AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM sets),
classes AS (SELECT k, min(doc_id) AS rep FROM sizes WHERE n > 0 GROUP BY k),
items AS (
  SELECT rep, n, unnest(s) AS g FROM classes JOIN sizes ON doc_id = rep JOIN sets USING (doc_id)
),
shared AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS i, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM items x JOIN items y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY ALL
),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM sizes LEFT JOIN classes ON sizes.k = classes.k AND n > 0 LEFT JOIN comp USING (rep)
"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH iw AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
wins AS (
  SELECT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS g,
    least(len(ws), 10) AS n
  FROM iw
),
grams AS (SELECT g, n, list(DISTINCT item_id) AS items FROM wins GROUP BY g, n),
dw AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
spots AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM grams))
),
hits AS (SELECT doc_id, s, p.n, items FROM spots p JOIN grams ON p.g = grams.g AND p.n = grams.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, unnest(items)::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9 = """
WITH RECURSIVE ls AS (
  SELECT doc_id, s AS parts, unnest(s) AS line, unnest(range(len(s))) AS no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
),
full_lines AS (SELECT doc_id, no, line FROM ls WHERE trim(line, ' ' || chr(9) || chr(13)) != ''),
classes AS (SELECT line, row_number() OVER (ORDER BY min((doc_id, no))) AS k, min((doc_id, no)) AS place FROM full_lines GROUP BY line),
sets AS (
  SELECT k, list_distinct(list_transform(range(1, greatest(length(line) - 11, 1) + 1), lambda i: substr(line, i, 12))) AS s FROM classes
),
items AS (SELECT k, len(s) AS n, unnest(s) AS g FROM sets),
often AS (SELECT g, count(*) AS f FROM items GROUP BY g HAVING count(*) > 1),
ranked AS (SELECT k, n, g, f, row_number() OVER (PARTITION BY k ORDER BY coalesce(f, 1), g) AS r FROM items LEFT JOIN often USING (g)),
heads AS (SELECT k, n, g FROM ranked WHERE f > 1 AND 100 * (n - r + 1) >= 80 * n),
near AS (
  SELECT DISTINCT x.k AS a, y.k AS b FROM heads x JOIN heads y ON x.g = y.g AND x.k < y.k AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
),
shared AS (
  SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) AS na, len(y.s) AS nb FROM near JOIN sets x ON x.k = a JOIN sets y ON y.k = b
),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
comp AS (SELECT a AS k, min(b) AS c FROM reach GROUP BY a),
stays AS (SELECT s.line, f.place FROM classes s LEFT JOIN comp USING (k) JOIN classes f ON f.k = coalesce(c, s.k)),
gone AS (SELECT doc_id, no FROM full_lines JOIN stays USING (line) WHERE (doc_id, no) != place)
SELECT ls.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone.no IS NULL) AS n_kept,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ls.no) FILTER (WHERE gone.no IS NULL), '')) AS text_sha256
FROM ls LEFT JOIN gone ON ls.doc_id = gone.doc_id AND ls.no = gone.no GROUP BY ls.doc_id
"""

OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)
),
starts AS (SELECT g, min((doc_id, s)) AS f FROM wins GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM wins JOIN starts USING (g) WHERE (doc_id, s) != f
),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t, count(gone.p) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP3 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS q
  FROM t GROUP BY conv_id
),
kept AS (
  SELECT min(conv_id) AS conv_id, n, q, count(*) AS n_equal FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.n > c.n AND d.q[1] = c.q[1] AND d.q[1:c.n] = c.q) GROUP BY n, q
)
SELECT conv_id, 0::BIGINT AS part, n AS n_turns, n_equal, array_to_string(list_transform(q,
  lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), '') AS chat
FROM kept
"""

ORACLES = {
    "op3_snapshot_collapsed_chats": OP3,
    "op2_doubling_substring_dedup": OP2,
    "op9_fuzzy_line_dedup": OP9,
    "op7_prefix_filter_decontamination": OP7,
    "op1_minhash_near_dedup": OP1,
}
