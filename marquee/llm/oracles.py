"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .lines import OP9_SQL

OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
last AS (SELECT payload_digest, max(page_id) AS answer FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN d.page_id < answer THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < answer THEN answer END AS refers_to
FROM d LEFT JOIN last USING (payload_digest)
"""

_FOLD = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5_SQL = f"""
WITH b AS (SELECT item_id, {_FOLD} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_FOLD}, []) AS w FROM documents),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)),
found AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON vec_id = comp.a LEFT JOIN n ON vec_id = n.a
"""



def _crc32(octets: str) -> str:
    """DuckDB SQL of a CRC-32, bit by bit. ``octets``: the bytes as a list."""
    step = "lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    bits = f"flatten(list_transform({octets}, lambda o: list_transform(range(0, 8), lambda k: (o >> k) & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295)"


_ASCII = "list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)"

OP12_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
branches AS (SELECT unnest(['L', 'R']) AS br),
parts AS (SELECT doc_id, unnest(list_concat(['row', 'lang', 'source'], list_transform(range(0, len(lines)), lambda j: CAST(j AS VARCHAR)))) AS part FROM docs),
names AS (SELECT br, doc_id, part, br || ':' || CAST(doc_id AS VARCHAR) || ':' || part AS name FROM parts, branches),
codes AS (SELECT br, doc_id, part, {_crc32(_ASCII)} % 11 AS code FROM names),
of AS (SELECT doc_id, part, max(CASE WHEN br = 'L' THEN code END) AS l, max(CASE WHEN br = 'R' THEN code END) AS r FROM codes GROUP BY ALL),
leaves AS (
  SELECT doc_id, part, CASE part WHEN 'lang' THEN lang WHEN 'source' THEN source ELSE lines[TRY_CAST(part AS INT) + 1] END AS b, part NOT IN ('lang', 'source') AS is_line, l, r
  FROM of JOIN docs USING (doc_id) WHERE part <> 'row'),
values_ AS (
  SELECT *, CASE l WHEN 0 THEN CASE WHEN NOT is_line THEN '' END WHEN 1 THEN b || '!' WHEN 2 THEN b || '?' ELSE b END AS x,
    CASE r WHEN 0 THEN CASE WHEN NOT is_line THEN '' END WHEN 1 THEN b || '!' WHEN 2 THEN b || '?' ELSE b END AS y,
    CASE WHEN is_line THEN CASE l WHEN 3 THEN '!' WHEN 4 THEN '?' END END AS gx, CASE WHEN is_line THEN CASE r WHEN 3 THEN '!' WHEN 4 THEN '?' END END AS gy
  FROM leaves),
merged AS (
  SELECT doc_id, part, is_line, b, x IS DISTINCT FROM b OR gx IS NOT NULL AS by_l, y IS DISTINCT FROM b OR gy IS NOT NULL AS by_r,
    CASE WHEN x IS NOT DISTINCT FROM b THEN y WHEN y IS NOT DISTINCT FROM b OR x IS NOT DISTINCT FROM y THEN x ELSE b END AS v,
    CASE WHEN gx IS NULL THEN gy WHEN gy IS NULL OR gx = gy THEN gx END AS g,
    (x IS DISTINCT FROM b OR y IS DISTINCT FROM b)::INT AS changed, (x IS DISTINCT FROM b AND y IS DISTINCT FROM b AND x IS DISTINCT FROM y)::INT AS clash,
    (x IS NULL OR y IS NULL)::INT AS gone, (gx IS NOT NULL OR gy IS NOT NULL)::INT AS put, (gx IS NOT NULL AND gy IS NOT NULL AND gx <> gy)::INT AS g_clash
  FROM values_),
rows_ AS (
  SELECT doc_id, bool_or(by_l) AS by_l, bool_or(by_r) AS by_r, max(v) FILTER (part = 'lang') AS lang, max(v) FILTER (part = 'source') AS source,
    coalesce(string_agg(CASE WHEN v IS NULL THEN g WHEN g IS NULL THEN v ELSE v || chr(10) || g END, chr(10) ORDER BY TRY_CAST(part AS INT)) FILTER (is_line AND coalesce(v, g) IS NOT NULL), '') AS text,
    sum(changed - clash + put - g_clash) AS n_clean, sum(clash * (1 - gone)) AS n_edit_edit, sum(clash * gone) AS n_edit_delete, sum(g_clash) AS n_insert_insert
  FROM merged GROUP BY doc_id),
kept AS (
  SELECT o.doc_id, o.l = 0 OR o.r = 0 AS dropped, (o.l = 0 AND o.r <> 0 AND by_r) OR (o.r = 0 AND o.l <> 0 AND by_l) AS clash,
    m.lang, m.source, text, d.lang AS base_lang, d.source AS base_source, array_to_string(d.lines, chr(10)) AS base_text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert
  FROM of o JOIN rows_ m USING (doc_id) JOIN docs d USING (doc_id) WHERE part = 'row'),
added AS (
  SELECT -1 - doc_id AS doc_id, 'L' AS br, lang, source, CASE l WHEN 3 THEN '!' ELSE '?' END AS text FROM of JOIN docs USING (doc_id) WHERE part = 'row' AND l IN (3, 4)
  UNION ALL SELECT -2 - doc_id, 'R', lang, source, CASE r WHEN 3 THEN '!' ELSE '?' END FROM of JOIN docs USING (doc_id) WHERE part = 'row' AND r IN (3, 4)),
fresh AS (SELECT doc_id, min(lang) AS lang, min(source) AS source, min(text) AS text, count(DISTINCT (lang, source, text)) = 1 AS ok FROM added GROUP BY 1)
SELECT doc_id, CASE WHEN clash THEN base_lang WHEN NOT dropped THEN lang END AS lang, CASE WHEN clash THEN base_source WHEN NOT dropped THEN source END AS source,
  CASE WHEN clash THEN sha256(base_text) WHEN NOT dropped THEN sha256(text) END AS text_sha256,
  CAST(CASE WHEN dropped THEN (NOT clash)::INT ELSE n_clean END AS BIGINT) AS n_clean, CAST(CASE WHEN dropped THEN 0 ELSE n_edit_edit END AS BIGINT) AS n_edit_edit,
  CAST(CASE WHEN dropped THEN clash::INT ELSE n_edit_delete END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN dropped THEN 0 ELSE n_insert_insert END AS BIGINT) AS n_insert_insert
FROM kept
UNION ALL SELECT doc_id, CASE WHEN ok THEN lang END, CASE WHEN ok THEN source END, CASE WHEN ok THEN sha256(text) END, ok::BIGINT, 0, 0, (NOT ok)::BIGINT FROM fresh
"""

#: a letter's UTF-8 bytes, of which the runs' letters have one or two
_OCTETS = "flatten(list_transform(string_split(name, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6)::BIGINT, 128 + (ord(c) & 63)::BIGINT] END))"

OP11_SQL = f"""
WITH RECURSIVE found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || run AS name FROM found WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32(_OCTETS)} AS h FROM counted),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1),
vocab AS (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2),
dels AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(0, length(word))) AS INT) AS i FROM vocab)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM dels a JOIN dels b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM vocab a JOIN dels b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM vocab a JOIN dels b ON a.word = b.rest),
near AS (SELECT a AS word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY 1),
firsts AS (SELECT a AS word, min(b) AS b FROM pairs JOIN near ON a = word AND n = most GROUP BY 1),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN b END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM vocab LEFT JOIN near USING (word) LEFT JOIN firsts USING (word)),
chain AS (SELECT word, word AS at FROM told UNION ALL SELECT chain.word, told.form FROM chain JOIN told ON chain.at = told.word WHERE told.form IS NOT NULL)
SELECT t.word, t.form, c.at AS root, t.n, t.n_near, t.form_n FROM told t JOIN chain c ON t.word = c.word JOIN told l ON c.at = l.word AND l.form IS NULL
"""

ORACLES = {
    "op2_warc": OP2_SQL,
    "op5_winnowing": OP5_SQL,
    "op8_pstable": OP8_SQL,
    "op9_line_spread": OP9_SQL,
    "op11_deletions": OP11_SQL,
    "op12_merkle": OP12_SQL,
}
