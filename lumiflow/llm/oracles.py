"""SQL for DuckDB that gives the rows of queries which SQL can express."""

from __future__ import annotations

from .quality_rules import quality_sql

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all({_FOLDED}, '{pattern}') AS ws FROM {table}"


_ALNUM, _SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

#: Windows of ten item words, held against windows of the same size in every text.
DECONTAMINATION = f"""
WITH w AS ({_words("documents", "doc_id", _ALNUM)}), b AS ({_words("benchmark", "item_id", _ALNUM)}),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS x FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) u(i) WHERE len(ws) > 0),
dw AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS x FROM w, (SELECT DISTINCT k FROM win) s, unnest(range(1, len(ws) - k + 2)) u(i) WHERE len(ws) >= k),
m AS (SELECT r, i, k, item_id FROM dw JOIN win USING (k, x)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""

#: All pairs that share a shingle, their exact similarity, and the smallest id that each document reaches.
NEAR_DEDUP = f"""
WITH RECURSIVE w AS ({_words("documents", "doc_id", _SPACED)}),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS x FROM w, unnest(range(1, greatest(len(ws), 2))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS low FROM w UNION SELECT e.b, c.low FROM c JOIN e ON c.doc_id = e.a WHERE c.low < e.b),
m AS (SELECT doc_id, min(low) AS low FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.low AS component_id, w.doc_id = m.low AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(x AS BIGINT)))"


def _crc(codes: str) -> str:
    """crc32 of a list of bytes, in a query that has the checksum's table as t.tab."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t.tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _bytes(text: str) -> str:
    """UTF-8 bytes of letters below U+0100 and ASCII."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))"


#: Rows one after the other: the best way into each state of the grammar, with up to two inserts before each row and at the end.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS tab),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_bytes("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))} % 20 AS h FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) u(i) WHERE h <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini, regexp_matches(text, '[^\x20\x09-\x0D]') AS has, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ended FROM d),
r AS (SELECT *, CASE WHEN NOT has THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT ended THEN 3 ELSE 0 END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM f),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) m(s, x, e)),
ins AS (SELECT s, s AS e, '' AS a FROM range(4) g(s) UNION ALL SELECT s, e, 'I' FROM moves WHERE x <> 's' UNION ALL SELECT p.s, q.e, 'II' FROM moves p JOIN moves q ON p.e = q.s WHERE p.x <> 's' AND q.x <> 's'),
edits AS (SELECT conv_id, i, m.s, m.e, 'K' AS a, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS c FROM r JOIN moves m ON m.x = ini WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, m.s, m.e, 'R', CASE WHEN fault = 3 THEN 6 ELSE 3 END FROM r JOIN moves m ON m.x <> 's' WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, s, s, 'D', 4 FROM r, range(4) g(s)),
way AS (SELECT DISTINCT conv_id, 0 AS i, 0 AS s, '000000000000' AS best FROM r
  UNION ALL SELECT w.conv_id, w.i + 1, x.e, min(lpad(CAST(CAST(best[1:12] AS BIGINT) + 3 * length(n.a) + x.c AS VARCHAR), 12, '0') || best[13:] || n.a || x.a)
  FROM way w JOIN ins n ON n.s = w.s JOIN edits x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 AND x.s = n.e GROUP BY w.conv_id, w.i, x.e),
size AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
won AS (SELECT w.conv_id, min(lpad(CAST(CAST(best[1:12] AS BIGINT) + 3 * length(n.a) AS VARCHAR), 12, '0') || best[13:] || n.a) AS best FROM way w JOIN size z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i JOIN ins n ON n.s = w.s WHERE n.e IN (0, 3) GROUP BY w.conv_id),
step AS (SELECT conv_id, k, best[12 + k] AS a, sum(CASE WHEN best[12 + k] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM won, unnest(range(1, length(best) - 11)) u(k)),
kept AS (SELECT s.conv_id, s.k, s.a, r.role, r.text FROM step s LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i AND s.a <> 'I' WHERE s.a <> 'D'),
line AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - CASE WHEN left(first_value(CASE WHEN a = 'K' THEN role ELSE 'u' END) OVER (PARTITION BY conv_id ORDER BY k), 1) = 's' THEN 1 ELSE 0 END AS p FROM kept),
body AS (SELECT conv_id, string_agg(CASE WHEN a = 'K' THEN role ELSE CASE WHEN p % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS body FROM line GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best[1:12], '0') AS BIGINT) AS cost, coalesce(best[13:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN size ON size.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN body ON body.conv_id IS NOT DISTINCT FROM c.conv_id"""

#: Words with one letter left out meet: equal rests at one place are a replacement, a rest that is a word an insertion.
SPELLING_VARIANTS = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS tab),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_FOLDED}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {_crc(_bytes("id || ':' || w"))} AS h FROM g, t),
x AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM v, unnest(range(1, length(word) + 1)) u(i)),
p AS (SELECT DISTINCT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON c.rest = v.word UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
near AS (SELECT a AS word, count(*) AS n_near, max(bn) AS top FROM p GROUP BY a),
form AS (SELECT near.word, n_near, min(b) FILTER (bn = top AND bn >= 10 * an) AS form, max(bn) FILTER (bn = top AND bn >= 10 * an) AS form_n FROM near JOIN p ON p.a = near.word GROUP BY near.word, n_near),
walk AS (SELECT word, form AS top FROM form WHERE form IS NOT NULL UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.top WHERE form.form IS NOT NULL),
ends AS (SELECT word, top FROM walk WHERE NOT EXISTS (SELECT 1 FROM form WHERE form.word = walk.top AND form.form IS NOT NULL))
SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, form_n, coalesce(ends.top, v.word) AS root FROM v LEFT JOIN form USING (word) LEFT JOIN ends USING (word)"""

#: All pairs of a label by cosine, and the smallest id that each vector reaches.
VECTOR_DEDUP = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
c AS (SELECT vec_id, vec_id AS low FROM e UNION SELECT l.b, c.low FROM c JOIN l ON c.vec_id = l.a WHERE c.low < l.b),
m AS (SELECT vec_id, min(low) AS low FROM c GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, low AS component_id, e.vec_id = low AS kept FROM e JOIN m USING (vec_id) LEFT JOIN k ON k.a = e.vec_id"""

ORACLE = {
    "op3_decontamination": DECONTAMINATION,
    "op4_near_dedup": NEAR_DEDUP,
    "op6_quality_rules": quality_sql(),
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_vector_dedup": VECTOR_DEDUP,
}
