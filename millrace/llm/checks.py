"""The operators' results in SQL, where SQL can express them."""

SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30
), of_lang AS (
  SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), tot AS (
  SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN of_lang l ON l.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
  LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.f, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

PREFIX_TRIE = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), tab AS (
  SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8
), t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), tab
), s AS (
  SELECT c.conv_id, 0 AS part, t.p, t.r, t.x FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h
), seq AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, md5(length(r) || ':' || r || x) AS key,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM s
), m AS (
  SELECT conv_id, d, md5(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d)) AS path, words FROM seq
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM c
), up AS (
  SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS above, d = max(d) OVER (PARTITION BY conv_id) AS last FROM m
), node AS (
  SELECT d, path, any_value(above) AS above, min(conv_id) AS cid, count(*) AS n, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM up GROUP BY d, path
), kids AS (
  SELECT above AS path, count(*) AS k FROM node WHERE d > 0 GROUP BY above
), sums AS (
  SELECT a.path, sum((u.n - 1) * u.words) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM node u LEFT JOIN kids ON kids.path = u.path JOIN m a ON a.conv_id = u.cid AND a.d <= u.d GROUP BY a.path
)
SELECT node.cid AS conv_id, node.d::BIGINT AS depth, top.cid AS parent_conv_id, node.n AS n_convs, coalesce(kids.k, 0)::BIGINT AS n_children,
  sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums ON sums.path = node.path LEFT JOIN kids ON kids.path = node.path LEFT JOIN node top ON top.path = node.above
"""
