"""DuckDB SQL for the queries that SQL can express: plain brute force over the whole tables."""

from __future__ import annotations

from .warc import BASE32

#: Classes and link counts from ``nodes`` (id) and ``links`` (a, b; both ways): the smallest id reachable by links.
_CLASSES = """
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS id, MIN(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS id, COUNT(*) AS n FROM links GROUP BY a)"""


def _class_rows(name: str) -> str:
    return f"""SELECT c.id AS {name}, c.component_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, c.id = c.component_id AS kept
FROM classes c LEFT JOIN counts n ON n.id = c.id"""


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH RECURSIVE nodes AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id FROM embeddings),
units AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.id AS a, q.id AS b FROM units p JOIN units q ON p.id <> q.id AND len(p.v) = len(q.v)
  WHERE list_cosine_similarity(p.v, q.v) >= 0.9),
{_CLASSES}
{_class_rows("vec_id")}
"""

_GROUP = "CAST('0x' || substr(hex, {at}, 5) AS BIGINT)"
_DIGITS = " || ".join(f"substr('{BASE32}', CAST(({_GROUP.format(at=5 * i + 1)} >> {shift}) & 31 AS INTEGER) + 1, 1)"
                      for i in range(8) for shift in (15, 10, 5, 0))

OP5 = f"""
WITH payloads AS (
  SELECT page_id, COALESCE(html, '') AS payload, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS hex FROM pages),
firsts AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload) AS first_page FROM payloads)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to, TRUE AS intact
FROM firsts
"""

OP6 = f"""
WITH split AS (SELECT doc_id, {_WORDS.format(text="COALESCE(text, '')")} AS words FROM documents),
placed AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM split),
windows AS (
  SELECT doc_id, pos, words[pos] AS word,
         CASE WHEN pos + 19 <= len(words) THEN array_to_string(words[pos:pos + 19], ' ') END AS run FROM placed),
judged AS (
  SELECT doc_id, pos, word,
         CASE WHEN run IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS again FROM windows),
covered AS (
  SELECT doc_id, pos, word, MAX(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
texts AS (
  SELECT doc_id, SUM(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM covered GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(COALESCE(t.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(t.kept, '')) AS kept_sha256
FROM split s LEFT JOIN texts t ON t.doc_id = s.doc_id
"""

OP9 = f"""
WITH RECURSIVE nodes AS (SELECT DISTINCT CAST(doc_id AS BIGINT) AS id FROM documents),
split AS (SELECT CAST(doc_id AS BIGINT) AS id, {_WORDS.format(text="lower(COALESCE(text, ''))")} AS words FROM documents),
shingles AS (
  SELECT DISTINCT id, array_to_string(words[pos:pos + 4], ' ') AS shingle
  FROM (SELECT id, words, unnest(range(1, GREATEST(len(words) - 3, 2))) AS pos FROM split WHERE len(words) > 0)),
sizes AS (SELECT id, COUNT(*) AS n FROM shingles GROUP BY id),
common AS (
  SELECT p.id AS a, q.id AS b, COUNT(*) AS n FROM shingles p JOIN shingles q ON p.shingle = q.shingle AND p.id <> q.id GROUP BY p.id, q.id),
links AS (
  SELECT o.a, o.b FROM common o JOIN sizes p ON p.id = o.a JOIN sizes q ON q.id = o.b WHERE 10 * o.n >= 8 * (p.n + q.n - o.n)),
{_CLASSES}
{_class_rows("doc_id")}
"""

OP11 = """
WITH whole AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor, a.label AS own, c.id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.id % 50 = 0 AND a.id <> c.id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor, id, score FROM scores WHERE label = own QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
banded AS (
  SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id, s.score,
         ROW_NUMBER() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scores s ON s.anchor = p.anchor AND s.label <> s.own
  WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM banded WHERE rank <= 3
"""

#: crc32 of UTF-8 bytes in two steps a byte, by the 16 remainders of the polynomial (0xEDB88320, reflected).
_NIBBLES = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES[_i] = _c

OP12 = f"""
WITH RECURSIVE docs AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS doc, COALESCE(text, '') AS text FROM documents),
found AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM docs)),
counted AS (SELECT doc, run, COUNT(*) AS n FROM found WHERE length(run) >= 6 GROUP BY doc, run),
nibbles AS (
  SELECT doc, run, n, hex(encode(doc || ':' || run)) AS h FROM counted),
steps AS (
  SELECT doc, run, n, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h)), lambda i:
      CAST(instr('0123456789ABCDEF', substr(h, CAST(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END AS INTEGER), 1)) - 1 AS BIGINT))),
    lambda c, x: xor(c >> 4, list_extract(CAST({_NIBBLES} AS BIGINT[]), CAST(xor(c, x) & 15 AS INTEGER) + 1))) AS c
  FROM nibbles),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM steps),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING SUM(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words),
without AS (SELECT word, n, pos, substr(word, 1, CAST(pos - 1 AS INTEGER)) || substr(word, CAST(pos + 1 AS INTEGER)) AS rest FROM places),
near AS (
  SELECT DISTINCT p.word AS a, p.n AS an, q.word AS b, q.n AS bn FROM without p JOIN without q ON p.pos = q.pos AND p.rest = q.rest AND length(p.word) = length(q.word) AND p.word <> q.word
  UNION SELECT p.word, p.n, w.word, w.n FROM without p JOIN words w ON w.word = p.rest
  UNION SELECT w.word, w.n, p.word, p.n FROM without p JOIN words w ON w.word = p.rest),
best AS (
  SELECT a AS word, COUNT(*) OVER (PARTITION BY a) AS n_near, b, bn FROM near QUALIFY ROW_NUMBER() OVER (PARTITION BY a ORDER BY bn DESC, b) = 1),
forms AS (
  SELECT w.word, w.n, CAST(COALESCE(t.n_near, 0) AS BIGINT) AS n_near, CASE WHEN t.bn >= 5 * w.n THEN t.b END AS form, CASE WHEN t.bn >= 5 * w.n THEN t.bn END AS form_n
  FROM words w LEFT JOIN best t ON t.word = w.word),
chains AS (SELECT word, form, word AS root FROM forms UNION ALL SELECT c.word, f.form, f.word FROM chains c JOIN forms f ON f.word = c.form)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chains c ON c.word = f.word AND c.form IS NULL
"""

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = f"""
WITH split AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM placed),
repeats AS (SELECT key, MAX(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3),
judged AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeats r ON r.key = k.key)
SELECT doc_id, COUNT(*) AS n_lines, CAST(COUNT(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLE = {"op2_embedding_dedup": OP2, "op5_warc": OP5, "op6_substring_dedup": OP6, "op9_jaccard_join": OP9, "op11_hard_negatives": OP11,
          "op12_spelling": OP12, "op13_line_dedup": OP13}
