"""The vector queries in SQL."""

_ROUND = """
d{n} AS (SELECT k.vec_id, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM kept k CROSS JOIN c{n} c),
a{n} AS MATERIALIZED (SELECT vec_id, min(struct_pack(distance := distance, cluster := cluster)) AS best FROM d{n} GROUP BY vec_id),
u{n} AS (SELECT a.best.cluster AS cluster, i, sum(k.v[i]) AS s, count(*) AS n FROM a{n} a JOIN kept k USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
m{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM u{n} GROUP BY cluster),
c{next} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m USING (cluster)),"""

CENTROIDS = (
    """
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY 1 LIMIT 16),"""
    + "".join(_ROUND.format(n=n, next=n + 1) for n in range(3))
    + """
d3 AS (SELECT k.vec_id, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM kept k CROSS JOIN c3 c),
a3 AS (SELECT vec_id, min(struct_pack(distance := distance, cluster := cluster)) AS best FROM d3 GROUP BY vec_id)
SELECT vec_id, best.cluster AS cluster, CAST(best.distance AS BIGINT) AS distance, CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.cluster = best.cluster"""
)

HARD_NEGATIVES = """
WITH kept AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS score FROM kept a CROSS JOIN kept b WHERE a.id % 50 = 0 AND a.id <> b.id),
near AS (SELECT a, b, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT n.a AS anchor_id, n.b AS positive_id, CAST(row_number() OVER (PARTITION BY n.a, n.b ORDER BY p.score DESC, p.b) AS INTEGER) AS rank, p.b AS negative_id,
  CAST(n.score AS BIGINT) AS positive_score, CAST(p.score AS BIGINT) AS negative_score
FROM near n JOIN pairs p ON p.a = n.a AND NOT p.same AND 50 * n.score <= 100 * p.score AND 100 * p.score <= 95 * n.score
QUALIFY row_number() OVER (PARTITION BY n.a, n.b ORDER BY p.score DESC, p.b) <= 3"""
