"""DuckDB SQL of the training-data queries that SQL can express in full:
plain definitions of the results, without the operators' methods."""

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{WORDS}') AS w FROM documents WHERE doc_id IS NOT NULL),
shingle AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                                                lambda s: md5(array_to_string(w[s:s + 4], ' ')))) AS x
  FROM doc WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_id AS (SELECT a AS doc_id, min(b) AS least_b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least_b, doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least_id USING (doc_id)"""

WARC = """
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM (SELECT page_id, payload, first_id, strlen(payload) >= 100 AND page_id > first_id AS again
      FROM (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages))"""

SUFFIX = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
piece AS (
  SELECT doc_id, 500 * c AS lo, substr(x, 1000 * c + 1, 1198) AS p
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 1000 + 1)) AS c FROM doc)),
string AS (
  SELECT doc_id, unnest(h) AS h, lo + generate_subscripts(h, 1) AS s
  FROM (SELECT doc_id, lo, list_transform(range(0, least(500, length(p) // 2 - 99)),
                                          lambda i: md5(substr(p, 2 * i + 1, 200))) AS h FROM piece)),
gone AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS place FROM string)
  WHERE place > 1),
byte AS (
  SELECT doc_id, unnest(b) AS b, lo + generate_subscripts(b, 1) AS i
  FROM (SELECT doc_id, lo, list_transform(range(0, least(500, length(p) // 2)), lambda i: substr(p, 2 * i + 1, 2)) AS b FROM piece)),
mark AS (
  SELECT byte.doc_id, b, i, coalesce(i - max(s) OVER (PARTITION BY byte.doc_id ORDER BY i) < 100, false) AS removed
  FROM byte LEFT JOIN gone ON gone.doc_id = byte.doc_id AND s = i),
edge AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM mark),
per AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (removed) AS r, count(*) FILTER (begins) AS spans,
    string_agg(b, '' ORDER BY i) FILTER (NOT removed) AS kept FROM edge GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM doc LEFT JOIN per USING (doc_id)"""

#: The template adds <, > and </s> to a turn and a letter to each control character.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(regexp_replace(role, '[^\\<>\[/]', '', 'g')) + length(text)
      + length(regexp_replace(text, '[^\\<>\[]', '', 'g')) + 6 AS chars
  FROM turns),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(so_far) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id"""

SUBSTRING = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (
  SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS s
  FROM (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda s: md5(array_to_string(w[s:s + 49], ' '))) AS h FROM doc)),
gone AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS first_id FROM win) WHERE doc_id > first_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM doc),
mark AS (
  SELECT word.doc_id, x, i, coalesce(i - max(s) OVER (PARTITION BY word.doc_id ORDER BY i) < 50, false) AS removed
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND s = i),
per AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (removed) AS r, string_agg(x, ' ' ORDER BY i) FILTER (NOT removed) AS kept
  FROM mark GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN per USING (doc_id)"""

ORACLES = {
    "op2_jaccard_join": JACCARD,
    "op4_warc": WARC,
    "op6_suffix_dedup": SUFFIX,
    "op9_chat_format": CHAT,
    "op10_substring_dedup": SUBSTRING,
}
