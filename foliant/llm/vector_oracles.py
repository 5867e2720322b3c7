"""Oracle SQL of the vector operators, built round by round."""

from __future__ import annotations


def ball_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Plain k-means: every part against every entry, in whole numbers."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""pieces AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) AS t(part))""",
        f"""book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM pieces
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""met{k} AS MATERIALIZED (
  SELECT vec_id, part, min((list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v))::BIGINT * {entries} + entry) AS code
  FROM pieces p JOIN book{k} b USING (part) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS v FROM (
      SELECT p.part, code % {entries} AS entry, i, floor(sum(p.v[i]) / count(*)) AS mean
      FROM pieces p JOIN met{k} USING (vec_id, part), unnest(range(1, len(p.v) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))""")
    return f"""
WITH {", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', code % {entries}), '' ORDER BY part) AS code, sum(code // {entries})::BIGINT AS error FROM met{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) FROM (
    SELECT part, entry, i, v[i] AS x FROM book{rounds}, unnest(range(1, len(v) + 1)) AS u(i))) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
