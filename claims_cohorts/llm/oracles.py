"""DuckDB SQL of the corpus queries whose contract is exact, written from the contract alone.

Each pair of documents or vectors is compared, every prefix and every run of words spelled out:
for small tables. The other queries have no SQL: signatures, learned models, tokenizers, packing
and approximate search are tested against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

#: Connected components of links(u, v), both directions, over nodes(id): comp(id, least).
COMPONENTS = """
reach(id, other) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.other
),
comp AS (SELECT id, min(other) AS least FROM reach GROUP BY id)"""

OP1 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM docs
),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
nodes AS (SELECT doc_id AS id FROM documents),{COMPONENTS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.least AS component_id, s.doc_id = c.least AS kept
FROM sets s JOIN comp c ON c.id = s.doc_id
"""

OP8 = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93
),
nodes AS (SELECT vec_id AS id FROM embeddings),{COMPONENTS}
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.least AS component_id, e.vec_id = c.least AS kept
FROM embeddings e JOIN comp c ON c.id = e.vec_id LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) n ON n.u = e.vec_id
"""

OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
),
runs AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM runs, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k
),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k AS size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, p.n AS l, q.n AS r,
    CAST((1000000::HUGEINT * c.a * c.a) // (p.n::HUGEINT * q.n) AS BIGINT) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM worst s WHERE NOT EXISTS (
    SELECT 1 FROM cand t WHERE t.lang = s.lang AND t.size = 3 AND 100 * t.a >= 50 * s.a
      AND (s.phrase = array_to_string(t.w[1:2], ' ') OR s.phrase = array_to_string(t.w[2:3], ' '))
  )
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""

#: crc32 of the decimal of ``conv_id``, a byte at a time, eight shifts a byte.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

OP12 = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS t
  FROM said GROUP BY conv_id
),
heads AS (SELECT *, {CRC} % 4 AS h FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(l.t[1 : c.h], []), c.t[c.h + 1 : len(c.t)]) AS t
  FROM heads c LEFT JOIN own l ON l.conv_id = c.conv_id - c.conv_id % 20
),
prefixes AS (SELECT conv_id, len(t) AS n, unnest(range(0, len(t) + 1)) AS d, t FROM built),
members AS (SELECT conv_id, n, d, t[1 : d] AS path FROM prefixes),
nodes AS (
  SELECT path, d, count(*) AS n_convs, min(conv_id) AS conv_id,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM members GROUP BY path, d
),
children AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
worth AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children,
    CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.path[n.d].text, {WORD})) END AS own_saved
  FROM nodes n LEFT JOIN children c ON c.path = n.path AND c.d = n.d
),
above AS (SELECT w.path[1 : a] AS path, a AS d, w.n_children, w.own_saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM worth) w),
subtrees AS (SELECT path, d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own_saved) AS BIGINT) AS saved_tokens FROM above GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
FROM worth w JOIN subtrees s ON s.path = w.path AND s.d = w.d LEFT JOIN nodes p ON p.path = w.path[1 : w.d - 1] AND p.d = w.d - 1
"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": OP1,
    "op8_embedding_near_dedup": OP8,
    "op11_phrase_collocations": OP11,
    "op12_conversation_trie": OP12,
}
