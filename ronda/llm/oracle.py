"""SQL of the registered queries, where SQL can express them."""

URL_FILTERS = r"""
WITH captures AS (
  SELECT page_id,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host,
         DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched
  FROM pages
), hosts AS (
  SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL
), parts AS (
  SELECT host, array_to_string(labels[i:], '.') AS domain
  FROM (SELECT host, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM hosts)
), listed AS (
  SELECT domain, ('0x' || substr(h, 1, 1))::INT AS a, ('0x' || substr(h, 2, 1))::INT AS b,
         ('0x' || substr(h, 3, 2))::INT AS d1, ('0x' || substr(h, 5, 2))::INT AS d2,
         ('0x' || substr(h, 7, 2))::INT AS d3, ('0x' || substr(h, 9, 1))::INT AS c
  FROM (SELECT DISTINCT domain, md5(domain) AS h FROM parts)
), entries AS (
  SELECT 'block' AS list, domain, 'add' AS action, 'adult' AS category, DATE '2024-01-01' + d1 AS dated FROM listed WHERE a < 4
  UNION ALL SELECT 'block', domain, 'add', 'phishing', DATE '2024-01-01' + (d1 + d2) FROM listed WHERE a < 4 AND b < 10
  UNION ALL SELECT 'block', domain, 'remove', NULL, DATE '2024-01-01' + (d1 + d2 + d3) FROM listed WHERE a < 4 AND b % 2 = 0
  UNION ALL SELECT 'allow', domain, 'add', 'partner', DATE '2024-01-01' + d2 FROM listed WHERE c < 2
  UNION ALL SELECT 'allow', domain, 'remove', NULL, DATE '2024-01-01' + (d2 + d3) FROM listed WHERE c < 2 AND b % 2 = 1
), latest AS (
  SELECT * FROM entries
  QUALIFY row_number() OVER (PARTITION BY list, domain, dated ORDER BY action DESC, category DESC NULLS LAST) = 1
), valid AS (
  SELECT *, lead(dated) OVER (PARTITION BY list, domain ORDER BY dated) AS valid_to FROM latest
), active AS (
  SELECT c.host, c.fetched, v.list, v.domain, v.category
  FROM (SELECT DISTINCT host, fetched FROM captures) c
  JOIN parts p ON p.host = c.host
  JOIN valid v ON v.domain = p.domain
  WHERE v.action = 'add' AND c.fetched >= v.dated AND (v.valid_to IS NULL OR c.fetched < v.valid_to)
), judged AS (
  SELECT host, fetched, count(*) OVER (PARTITION BY host, fetched) AS n_active, list, domain, category
  FROM active
  QUALIFY row_number() OVER (PARTITION BY host, fetched ORDER BY length(domain) DESC, list = 'allow' DESC) = 1
)
SELECT c.page_id, c.host, c.fetched, coalesce(j.list, 'none') AS verdict, j.domain, j.category,
       coalesce(j.n_active, 0) AS n_active
FROM captures c LEFT JOIN judged j ON j.host = c.host AND j.fetched = c.fetched
"""

HARD_NEGATIVES = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

ORACLE: dict[str, str] = {"op6_url_filters": URL_FILTERS, "op13_hard_negatives": HARD_NEGATIVES}
