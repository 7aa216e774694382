"""DuckDB SQL for the operators that SQL can express, by brute force over the whole tables."""
from __future__ import annotations

LOWER = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = "regexp_extract_all(" + LOWER + r", '[^\x20\x09-\x0D]+')"
ALNUM = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED.format(x='text')} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
                                 ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 80 * (na.n + nb.n - p.i)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT l.b, r.r FROM reach r JOIN links l ON l.a = r.a WHERE r.r < l.b),
comp AS (SELECT a, min(r) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp c ON c.a = d.doc_id"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, unnest(range(0, len(h) // 2 - 399)) AS p, unnest(list_transform(range(0, len(h) // 2 - 399), lambda i: hash(substr(h, 2 * i + 1, 800)))) AS k
  FROM d WHERE len(h) >= 800),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM win SEMI JOIN again USING (k)),
runs AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY doc_id, run),
sides AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (
  SELECT s.doc_id, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(d.h), 2 * max(b) + 1) AS h,
         sum(b - a) AS gone, count(*) AS n
  FROM sides s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, coalesce(k.n, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM.format(x='text')} AS w FROM documents),
b AS (SELECT item_id, {ALNUM.format(x='text')} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
win AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM d, (SELECT DISTINCT m FROM pat) z, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
hit AS (SELECT win.doc_id, win.i, win.m, pat.item_id FROM win JOIN pat ON win.s = pat.s AND win.m = pat.m),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov c USING (doc_id) LEFT JOIN its t USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS f FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
       CASE WHEN m.f IS NOT NULL AND page_id <> m.f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.f IS NOT NULL AND page_id <> m.f THEN m.f END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h"""

VECTOR_LINKS = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS r FROM e UNION SELECT l.b, r.r FROM reach r JOIN links l ON l.a = r.a WHERE r.r < l.b),
comp AS (SELECT a, min(r) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id JOIN comp c ON c.a = e.vec_id"""

FINITE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"

HARD_NEGATIVES = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda v: floor(256 * v)) AS x
  FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10"""

NEAREST = f"""
WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {FINITE} AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.x, b.x) AS score FROM r a JOIN r b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

# crc32 bit by bit over the UTF-8 bytes (all of one or two bytes here); near words by equal deletions
VARIANTS = """
WITH RECURSIVE run AS (
  SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
bytes AS (
  SELECT d, w, n, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM run),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(flatten(list_transform(b, lambda x: list_transform(range(8), lambda j: CAST((x >> CAST(j AS INTEGER)) & 1 AS BIGINT)))),
         lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)), CAST(4294967295 AS BIGINT))) AS h FROM bytes),
slip AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slip WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS s FROM cut),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS m FROM near GROUP BY word),
top AS (SELECT near.word, any_value(n_near) AS n_near, any_value(m) AS m, min(other) AS other FROM near JOIN best ON near.word = best.word AND near.n = best.m GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN top ON top.word = v.word),
walk AS (SELECT word, word AS reached, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.reached WHERE f.form IS NOT NULL),
root AS (SELECT word, max_by(reached, step) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, root.root, f.n, f.n_near, f.form_n FROM f JOIN root ON root.word = f.word"""
