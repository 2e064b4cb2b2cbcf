"""SQL that states the results of the operators on embeddings."""

from __future__ import annotations

USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0"

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {USABLE}),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_inner_product(a.w, v.w)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {USABLE} AND list_max(embedding) - list_min(embedding) + abs(embedding[1]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def pivot_codes_sql(rounds: int = 4) -> str:
    """Every assignment over all entries, round after round."""
    steps = [f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w, len(embedding) // 4 AS d FROM embeddings WHERE {USABLE}),
x AS (SELECT vec_id, label, p AS part, w[p * d + 1:(p + 1) * d] AS x FROM v, range(4) AS t(p)),
b0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INT AS entry, x AS e FROM x QUALIFY entry < 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS (
  SELECT vec_id, label, part, x, entry, list_inner_product(x, x) + list_inner_product(e, e) - 2 * list_inner_product(x, e) AS gap FROM x JOIN b{k} USING (part)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY gap, entry) = 1)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT part, entry, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS e FROM s{k} GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    steps.append(f"""
h AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM a{rounds} GROUP BY 1)""")
    return ",".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"""
