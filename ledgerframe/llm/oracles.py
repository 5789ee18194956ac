"""DuckDB SQL for the corpus queries that SQL can express."""

CURRICULUM_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
ranked AS (
  SELECT source, source_size, rnk, CAST(rnk % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap,
         CAST(source_size * 3 AS DOUBLE) / CAST(rnk % 3 + 1 AS DOUBLE) AS fill
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk
        FROM sized GROUP BY source)),
level AS (
  SELECT *, (SELECT CAST(sum(source_size) AS DOUBLE) FROM ranked)
            - coalesce(sum(cap) OVER (ORDER BY fill, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER (ORDER BY fill, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM ranked),
open_level AS (SELECT lft, ws FROM level WHERE NOT (cap * ws < lft * w) ORDER BY fill, rnk LIMIT 1),
targets AS (
  SELECT source, rnk, source_size,
         CASE WHEN cap * ws < lft * w THEN cap
              ELSE (SELECT lft FROM open_level) * w / (SELECT ws FROM open_level) END AS target
  FROM level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rnk, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM placed),
taken AS (
  SELECT *, greatest(0, least(size, words - passes * source_size - start)) AS part FROM cut),
put AS (
  SELECT *, passes * size + part AS taken, CASE rnk % 3 WHEN 0 THEN -0.8 WHEN 1 THEN 0.0 ELSE 0.8 END::DOUBLE AS a,
         least((0 + start + size / 2.0::DOUBLE) / words, 1.0::DOUBLE) AS q
  FROM taken)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CAST(floor((CASE WHEN a = 0 THEN q
            ELSE (sqrt((1 - a) * (1 - a) + 4 * a * q) - (1 - a)) / (2 * a) END) * 1e9) AS BIGINT) END AS position_ppb
FROM put
"""

VA_TOPK = r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.n <> b.n AND len(a.q) = len(b.q)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
split AS MATERIALIZED (
  SELECT lang, phrase, m, w, f AS a, k, lang || chr(9) || array_to_string(w[1:k], ' ') AS lp, lang || chr(9) || array_to_string(w[k + 1:m], ' ') AS rp
  FROM f, (SELECT unnest([1, 2]) AS k) WHERE k < m),
named AS MATERIALIZED (SELECT lang || chr(9) || phrase AS p, f FROM f),
lefts AS MATERIALIZED (SELECT split.*, f AS l FROM split JOIN named ON p = lp),
cuts AS (
  SELECT lefts.*, f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * f) AS score FROM lefts JOIN named ON p = rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(a) AS most, count(*) FILTER (front) AS n_left, count(*) FILTER (NOT front) AS n_right
  FROM (SELECT lang, f AS a, array_to_string(w[2:3], ' ') AS phrase, true AS front FROM f WHERE m = 3
        UNION ALL SELECT lang, f, array_to_string(w[1:2], ' '), false FROM f WHERE m = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT b.*, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase AND b.m = 2
  WHERE o.most IS NULL OR 100 * o.most < 50 * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

PREFIX_TRIE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS tab
  FROM (SELECT unnest(range(256)) AS b)),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
spread AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM ids, crc_table),
own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), txt := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.seq[1:h], []), o.seq[h + 1:]) AS seq
  FROM spread s JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = s.base),
paths AS (
  SELECT conv_id, d, seq[1:d] AS node, len(seq) = d AS ends, coalesce(len(seq[d].txt), 0) AS chars
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT CAST(node AS VARCHAR) || '#' || d AS id, any_value(node) AS node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY node, d),
linked AS (SELECT *, CASE WHEN depth > 0 THEN CAST(node[1:depth - 1] AS VARCHAR) || '#' || (depth - 1) END AS parent FROM nodes),
children AS (SELECT parent AS id, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
ups AS (
  SELECT CAST(node[1:e] AS VARCHAR) || '#' || e AS id, saved, n_children IS NULL AS leaf
  FROM (SELECT l.*, c.n_children, unnest(range(0, depth + 1)) AS e FROM linked l LEFT JOIN children c USING (id))),
below AS (SELECT id, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM ups GROUP BY id)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, l.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN linked p ON p.id = l.parent LEFT JOIN children c ON c.id = l.id JOIN below b ON b.id = l.id
"""

URL_RULES = r"""
WITH RECURSIVE rules(verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS tail FROM pages),
parts AS (
  SELECT page_id, url, html, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(tail, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM rest),
addressed AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, ':(?:80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END || query END AS address FROM parts),
tags AS (
  SELECT url, address, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<template\b.*?(?:</template\b|\z)|<textarea\b.*?(?:</textarea\b|\z)', ' ', 'gis'),
         '<(?:link|meta)\b[^<>]*>', 0, 'i')) AS tag
  FROM addressed WHERE host <> '' AND regexp_matches(html, 'canonical|http-equiv', 'i')),
asked AS (
  SELECT url, address, trim(CASE
    WHEN tag ILIKE '<link%' AND regexp_matches(tag, '\srel\s*=\s*["'']?(?:[^"''>]*\s)?canonical(?:\s|["''/>])', 'i') THEN regexp_extract(tag, '\shref\s*=\s*["'']?([^\s"''>]*)', 1, 'i')
    WHEN tag ILIKE '<meta%' AND regexp_matches(tag, '\shttp-equiv\s*=\s*["'']?refresh', 'i') THEN regexp_extract(tag, '\scontent\s*=\s*["'']?[\d.\s]*[;,]\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1, 'i')
    ELSE '' END) AS link
  FROM tags),
targets AS (SELECT address AS a, link AS t FROM asked WHERE regexp_matches(link, '^https?://', 'i')),
edges AS (
  SELECT a, translate(regexp_extract(t[strpos(t, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || coalesce(nullif(regexp_extract(t[strpos(t, '://') + 3:], '^[^/?#]*([^#]*)', 1), ''), '/') AS b FROM targets),
edges_both AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM edges_both UNION SELECT r.a, x.b FROM reach r JOIN edges_both x ON x.a = r.b),
fitted AS (
  SELECT k.*, r.verdict, r.rh || r.rp AS rule, row_number() OVER (PARTITION BY k.page_id, k.address, k.url ORDER BY length(r.rh || r.rp) DESC NULLS LAST, length(r.rh) DESC) AS pick
  FROM addressed k LEFT JOIN rules r ON (k.host = r.rh OR ends_with(k.host, '.' || r.rh)) AND starts_with(k.path, r.rp)),
nodes AS (SELECT DISTINCT b AS node, split_part(b, '/', 1) AS host, '/' || regexp_extract(b, '^[^/]*/([^?]*)', 1) AS path FROM edges_both),
marked AS (
  SELECT node, arg_max(verdict, length(rh || rp) * 1000 + length(rh)) AS verdict
  FROM nodes JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node),
fallen AS (
  SELECT a AS address FROM reach JOIN marked ON node = b GROUP BY a HAVING count(*) FILTER (verdict = 'allow') = 0)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN address IN (SELECT address FROM fallen) THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted WHERE pick = 1
"""
