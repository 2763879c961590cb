"""The fixtures of ``fixtures`` as DuckDB CTEs, in long form; every SQL twin builds on them."""

from __future__ import annotations

BASE = """
WITH examples AS (
  SELECT vec_id AS example_idx, label AS class_idx,
         CASE WHEN vec_id % 10 = 0 THEN 'test' WHEN vec_id % 10 = 1 THEN 'val' ELSE 'train' END AS split,
         CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
cv0 AS (
  SELECT class_idx, i, avg(x) AS m
  FROM (SELECT class_idx, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS i FROM examples WHERE split = 'train')
  GROUP BY class_idx, i),
class_vectors AS (
  SELECT class_idx, list(m / nrm ORDER BY i) AS vec
  FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY class_idx)) AS nrm FROM cv0) GROUP BY class_idx),
qc AS (
  SELECT e.split AS query_split, e.example_idx AS query_idx, e.class_idx AS true_class, c.class_idx AS class_idx,
         list_dot_product(e.vec, c.vec) AS sim
  FROM examples e CROSS JOIN class_vectors c),
sims AS (
  SELECT q.split AS query_split, q.example_idx AS query_idx, q.class_idx AS true_class, g.example_idx AS example_idx,
         g.class_idx AS example_class, list_dot_product(q.vec, g.vec) AS similarity
  FROM examples q JOIN examples g ON g.split = 'train' AND q.example_idx <> g.example_idx),
pools AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_idx ORDER BY similarity DESC, example_idx) - 1 AS INTEGER) AS position
    FROM sims WHERE query_split IN (:splits)) WHERE position < 30),
zero AS (SELECT query_split, query_idx, true_class, class_idx, sim - 3 AS s FROM qc WHERE query_split IN (:splits)),
pair AS (
  SELECT p.query_split, p.query_idx, p.true_class, p.position, p.example_idx, p.example_class, p.similarity, c.class_idx,
         c.sim + 0.5 * ec.sim + CASE WHEN c.class_idx = p.example_class THEN 0.3 * p.similarity ELSE 0 END - 3 AS s
  FROM pools p JOIN qc c ON p.query_idx = c.query_idx JOIN qc ec ON ec.query_idx = p.example_idx AND ec.class_idx = c.class_idx),
crank AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_idx ORDER BY sim DESC, class_idx) AS INTEGER) AS rank
  FROM qc WHERE class_idx <> true_class AND query_split IN (:splits)),
ks AS (SELECT unnest([2, 4, 6, 8, 10]) AS k),
members AS (
  SELECT query_split, query_idx, true_class, k, class_idx FROM crank JOIN ks ON rank <= k - 1
  UNION ALL SELECT DISTINCT query_split, query_idx, true_class, k, true_class FROM crank CROSS JOIN ks),
cond AS (
  SELECT 'zero_shot' AS condition, query_split, query_idx, true_class, class_idx, s FROM zero
  UNION ALL SELECT 'top1', query_split, query_idx, true_class, class_idx, s FROM pair WHERE position = 0),
condk AS (
  SELECT c.condition, m.k, c.query_split, c.query_idx, c.true_class, c.class_idx, c.s
  FROM cond c JOIN members m ON c.query_idx = m.query_idx AND c.class_idx = m.class_idx),
"""


def metrics(name: str, source: str, keys: str) -> str:
    """CTEs with the closed-set metrics of the long score table ``source``, one row for ``keys``."""
    return f"""
{name}_w AS (
  SELECT *, max(CASE WHEN class_idx = true_class THEN s END) OVER (PARTITION BY {keys}) AS st,
         ln(sum(exp(s)) OVER (PARTITION BY {keys})) AS lse,
         CAST(row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, class_idx) AS INTEGER) AS rn FROM {source}),
{name} AS (
  SELECT {keys}, true_class, max(CASE WHEN rn = 1 THEN class_idx END) AS predicted, bool_or(rn = 1 AND class_idx = true_class) AS correct,
         max(CASE WHEN class_idx = true_class THEN rn END) AS true_rank, max(st) AS true_score, max(st) - max(lse) AS log_probability,
         exp(max(st) - max(lse)) AS probability, max(st) - max(CASE WHEN class_idx <> true_class THEN s END) AS margin,
         max(CASE WHEN rn = 1 THEN s END) - max(CASE WHEN rn = 2 THEN s END) AS gap, -sum(exp(s - lse) * (s - lse)) AS entropy,
         min(CASE WHEN class_idx <> true_class THEN rn END) AS wrong_rn,
         max(CASE WHEN class_idx <> true_class THEN s END) AS strongest_wrong_score,
         first(class_idx ORDER BY CASE WHEN class_idx = true_class THEN 1 ELSE 0 END, rn) AS strongest_wrong
  FROM {name}_w GROUP BY {keys}, true_class),
"""


def base(*splits: str) -> str:
    named = ", ".join(f"'{s}'" for s in (splits or ("test", "val", "train")))
    return BASE.replace(":splits", named)


CAND = metrics("pm", "pair", "query_split, query_idx, position, example_idx, example_class, similarity") + metrics("zm", "zero", "query_split, query_idx") + """
cand AS (
  SELECT p.*, z.correct AS z_correct, z.margin AS z_margin, z.log_probability AS z_log_probability, z.probability AS z_probability,
         z.true_score AS z_true_score, c.sim + 0.5 * p.similarity AS score, 1 / (1 + exp(-4 * p.margin)) AS target
  FROM pm p JOIN zm z ON p.query_idx = z.query_idx JOIN qc c ON c.query_idx = p.query_idx AND c.class_idx = p.example_class),
picks AS (
  SELECT query_split, query_idx, position, 'top1' AS selector FROM pools WHERE position = 0
  UNION ALL SELECT query_split, query_idx, first(position ORDER BY score DESC, position), 'scorer' FROM cand GROUP BY query_split, query_idx
  UNION ALL SELECT p.query_split, p.query_idx, first(position ORDER BY c.sim DESC, position), 'label_match'
    FROM pools p JOIN qc c ON p.query_idx = c.query_idx AND p.example_class = c.class_idx GROUP BY p.query_split, p.query_idx
  UNION ALL SELECT query_split, query_idx, first(position ORDER BY md5('5:' || query_idx || ':' || example_idx)), 'random' FROM pools GROUP BY query_split, query_idx),
has AS (SELECT query_idx, bool_or(example_class = true_class) AS pool_has_true FROM pools GROUP BY query_idx),
sel AS (
  SELECT s.query_split, s.query_idx, s.position, s.selector, c.true_class, c.example_idx, c.example_class, h.pool_has_true, c.correct, c.margin, c.score
  FROM picks s JOIN cand c ON s.query_idx = c.query_idx AND s.position = c.position JOIN has h ON h.query_idx = s.query_idx),
"""
