"""DuckDB twins of the corpus queries that SQL can express over the given tables."""

import string

_WORDS = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
WITH RECURSIVE split AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM split),
classes AS (SELECT min(doc_id) AS c, s, len(s) AS n, count(*) AS copies FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.g = b.g AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, t.doc_id) AS component_id,
  CAST(coalesce((SELECT count(*) FROM links l WHERE l.a = k.c), 0) AS BIGINT) AS n_links,
  CAST(coalesce(k.copies, 1) AS BIGINT) AS n_copies
FROM sets t LEFT JOIN classes k ON k.s = t.s LEFT JOIN named m ON m.c = k.c"""

# All pages of the tables mark their article, so that markup alone gives their text.
_block = "regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
    _block = f"replace({_block}, '{_name}', '{_sign}')"
OP3 = f"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace({_block}, '[[:space:]]+', ' ', 'g'))), lambda b: b <> ''), chr(10) || chr(10)) AS text
  FROM pages)"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""

# crc32 of a decimal number: a bit at a time, over the bytes of its text.
_crc32 = """list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(c) + 1),
    lambda i: [CAST(ascii(substr(c, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""
OP13 = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
named AS (SELECT conv_id, t, CAST(conv_id AS VARCHAR) AS c FROM turns),
heads AS (SELECT conv_id, t, xor(CAST({_crc32} AS BIGINT), 4294967295) % 6 AS h FROM named),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.t[1:o.h], []), o.t[o.h + 1:]) AS t
  FROM heads o LEFT JOIN turns b ON b.conv_id = o.conv_id - o.conv_id % 100),
members AS (SELECT conv_id, t, d, t[1:d] AS path FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = d), '')) AS ends_sha256
  FROM members GROUP BY path, d),
own AS (
  SELECT n.path, n.d, n.conv_id, n.n_convs, n.ends_sha256, count(k.d) AS n_children,
    CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.path[n.d].text) END AS saved
  FROM nodes n LEFT JOIN nodes k ON k.d = n.d + 1 AND k.path[1:n.d] = n.path
  GROUP BY n.path, n.d, n.conv_id, n.n_convs, n.ends_sha256),
sums AS (
  SELECT path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON s.path = o.path LEFT JOIN own p ON o.d > 0 AND p.d = o.d - 1 AND p.path = o.path[1:o.d - 1]"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1, "op3_host_suffixes": OP3, "op11_lemp_negatives": OP11, "op13_prefix_trie": OP13}
