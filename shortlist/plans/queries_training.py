"""Queries for preference pairs, losses, scorers, and incremental work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import integrity, pairs, retrieval, scorers
from ..sources import scratch
from ..streaming import shards
from .base_sql import CAND, base
from .fixtures import N_CLASSES, World, table
from .registry import also, query, rounded

END = " x AS (SELECT 1) "
PAIRS = CAND + """
pp AS (SELECT a.query_split, a.query_idx, a.position AS i, b.position AS j, a.score - b.score AS ds, a.target - b.target AS dt, a.target AS ti, b.target AS tj
  FROM cand a JOIN cand b ON a.query_idx = b.query_idx AND a.position < b.position WHERE abs(a.target - b.target) > 0.02)
"""


def SOFT(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


PAIRLOSS = f"coalesce(avg({SOFT('-sign(dt) * ds')}), 0)"
CROSS = CAND + f"""
cq AS (SELECT a.query_idx, avg({SOFT('-(a.score - b.score)')}) AS l FROM cand a JOIN cand b ON a.query_idx = b.query_idx AND a.correct AND NOT b.correct GROUP BY a.query_idx)
"""
LIST = """
, lq AS (SELECT query_idx, ln(sum(exp(score))) - ln(sum(exp(score)) FILTER (correct)) AS l FROM cand GROUP BY query_idx HAVING bool_or(correct))
"""
BCE = "avg(greatest(score, 0) - score * target + ln(1 + exp(-abs(score))))"


def _cand(spark, sf_dir):
    return World(spark, sf_dir).ranked


SPLITS = base()


@query(SPLITS + PAIRS + "SELECT query_split, query_idx, i, j, round(ds, 6) + 0.0 AS ds, round(dt, 6) + 0.0 AS dt FROM pp")
def p1_preference_pairs(spark, sf_dir):
    return rounded(pairs.preference_pairs(_cand(spark, sf_dir)))


@query(SPLITS + PAIRS + f"SELECT count(*) AS pairs, round({PAIRLOSS}, 6) AS loss FROM pp")
def p2_pairwise_loss(spark, sf_dir):
    return rounded(pairs.pairwise_loss(_cand(spark, sf_dir)))


@query(SPLITS + PAIRS + f"""
, r AS (SELECT query_idx, position, exp(target / 0.5) / sum(exp(target / 0.5)) OVER (PARTITION BY query_idx) AS r FROM cand),
w AS (SELECT pp.*, a.r + b.r AS w FROM pp JOIN r a ON a.query_idx = pp.query_idx AND a.position = i JOIN r b ON b.query_idx = pp.query_idx AND b.position = j)
SELECT count(*) AS pairs, round(sum(w * {SOFT('-sign(dt) * ds')}) / sum(w), 6) AS loss FROM w
""")
def p3_weighted_loss(spark, sf_dir):
    return rounded(pairs.weighted_pairwise_loss(_cand(spark, sf_dir), 0.5))


@query(SPLITS + CROSS + "SELECT count(*) AS queries, round(coalesce(avg(l), 0), 6) AS loss FROM cq")
def p4_crossing_loss(spark, sf_dir):
    return rounded(pairs.crossing_loss(_cand(spark, sf_dir)))


@query(SPLITS + CROSS + f"""
, mp AS (SELECT a.score - b.score AS ds, a.margin - b.margin AS dt FROM cand a JOIN cand b ON a.query_idx = b.query_idx AND a.position < b.position WHERE abs(a.margin - b.margin) > 0.02)
SELECT round((SELECT coalesce(avg(l), 0) FROM cq) + 0.3 * (SELECT {PAIRLOSS} FROM mp), 6) AS loss
""")
def p5_crossing_margin_loss(spark, sf_dir):
    return rounded(pairs.crossing_with_margin_loss(_cand(spark, sf_dir), 0.3))


@query(SPLITS + PAIRS + "SELECT count(*) AS pairs, round(avg(CAST(sign(ds) = sign(dt) AS DOUBLE)), 6) AS accuracy FROM pp")
def p6_pairwise_accuracy(spark, sf_dir):
    return rounded(pairs.pairwise_accuracy(_cand(spark, sf_dir)))


@query(SPLITS + PAIRS + LIST + "SELECT count(*) AS queries, round(coalesce(avg(l), 0), 6) AS loss FROM lq")
def p7_listwise_loss(spark, sf_dir):
    return rounded(pairs.listwise_loss(_cand(spark, sf_dir)))


@query(SPLITS + PAIRS + LIST + f"SELECT round((SELECT {PAIRLOSS} FROM pp) + 0.25 * (SELECT coalesce(avg(l), 0) FROM lq), 6) AS loss")
def p8_hybrid_listwise_loss(spark, sf_dir):
    return rounded(pairs.hybrid_listwise_loss(_cand(spark, sf_dir)))


@query(SPLITS + CAND + END + f"SELECT round({BCE}, 6) AS loss FROM cand")
def p9_bce_loss(spark, sf_dir):
    return rounded(pairs.bce_loss(_cand(spark, sf_dir)))


@query(SPLITS + CAND + END + "SELECT round(avg(CASE WHEN abs(score - target) <= 0.4 THEN (score - target) * (score - target) / 2 ELSE 0.4 * (abs(score - target) - 0.2) END), 6) AS loss FROM cand")
def p10_huber_loss(spark, sf_dir):
    return rounded(pairs.huber_loss(_cand(spark, sf_dir), 0.4))


@query(SPLITS + PAIRS + f"SELECT round((SELECT {BCE} FROM cand) + 0.1 * (SELECT {PAIRLOSS} FROM pp), 6) AS loss")
def p11_hybrid_pointwise_loss(spark, sf_dir):
    return rounded(pairs.hybrid_pointwise_loss(_cand(spark, sf_dir)))


for _f in (
    p1_preference_pairs, p2_pairwise_loss, p3_weighted_loss, p4_crossing_loss, p5_crossing_margin_loss, p6_pairwise_accuracy, p7_listwise_loss,
    p8_hybrid_listwise_loss, p9_bce_loss, p10_huber_loss, p11_hybrid_pointwise_loss,
):
    also(f"{_f.__name__}_whole", _f)


FEATURES = """
f AS (SELECT p.query_idx, p.position, list_cosine_similarity(q.vec, c.vec) AS a, list_cosine_similarity(g.vec, c.vec) AS b, p.similarity AS s, p.position / 29.0::DOUBLE AS r
      FROM pools p JOIN examples q ON q.example_idx = p.query_idx JOIN examples g ON g.example_idx = p.example_idx JOIN class_vectors c ON c.class_idx = p.example_class)
"""


@query(base() + FEATURES + """
SELECT query_idx, position, round(1.5 * a + 0.25 * b + 0.5 * s - 0.1 * r + 0.05, 6) + 0.0 AS score FROM f
""")
def p12_linear_scorer(spark, sf_dir):
    w = World(spark, sf_dir)
    f = retrieval.pool_features(w.pool, w.queries, w.gallery, w.cv, 30)
    x = F.array("query_label", "example_label", "similarity", "rank_fraction")
    return rounded(f.select("query_idx", "position", scorers.linear(x, [1.5, 0.25, 0.5, -0.1], 0.05).alias("score")))


_RNG = np.random.default_rng(3)
LAYERS = (_RNG.normal(size=(4, 8)), _RNG.normal(size=8), _RNG.normal(size=8), 0.1, _RNG.normal(size=4), _RNG.normal(size=4))


def _layers_sql() -> str:
    """The two layers in SQL, with the error function by its series of positive terms."""
    w1, b1, w2, b2, scale, shift = LAYERS
    z = [f"((x[{i + 1}] - mu) / sqrt(var + 1e-5) * {float(scale[i])!r} + {float(shift[i])!r})" for i in range(4)]
    h = ", ".join(" + ".join([repr(float(b1[j])), *(f"{z[i]} * {float(w1[i, j])!r}" for i in range(4))]) for j in range(8))
    erf = "CASE WHEN abs(v) > 6 THEN sign(v) ELSE 2 / sqrt(pi()) * exp(-v * v) * list_sum(list_transform(range(150), lambda n: v * exp(n * ln(2 * v * v + 1e-300) - odd[n + 1]))) END"
    out = " + ".join([repr(b2), *(f"g[{j + 1}] * {float(w2[j])!r}" for j in range(8))])
    return f"""
x AS (SELECT query_idx, position, [a, b, s, r] AS x, (a + b + s + r) / 4 AS mu, (a * a + b * b + s * s + r * r) / 4 - ((a + b + s + r) / 4) ** 2 AS var FROM f),
h AS (SELECT query_idx, position, unnest([{h}]) AS h, unnest(range(8)) AS j FROM x),
odd AS (SELECT list(c ORDER BY n) AS odd FROM (SELECT n, sum(ln(2 * n + 1)) OVER (ORDER BY n) AS c FROM (SELECT unnest(range(150)) AS n))),
e AS (SELECT query_idx, position, j, h, {erf} AS erf FROM (SELECT *, h / sqrt(2) AS v FROM h), odd),
g AS (SELECT query_idx, position, list(h * (1 + erf) / 2 ORDER BY j) AS g FROM e GROUP BY query_idx, position)
SELECT query_idx, position, round({out}, 5) + 0.0 AS score FROM g
"""


@query(base() + FEATURES + "," + _layers_sql())
def p12_two_layer_scorer(spark, sf_dir):
    w = World(spark, sf_dir)
    f = retrieval.pool_features(w.pool, w.queries, w.gallery, w.cv, 30)
    rows = f.select("query_idx", "position", F.array("query_label", "example_label", "similarity", "rank_fraction").alias("x"))
    w1, b1, w2, b2, scale, shift = LAYERS
    return rounded(scorers.two_layer(rows, "x", w1, b1, w2, b2, scale=scale, shift=shift).drop("x"), 5)


@query()
def p13_fitted_ranker(spark, sf_dir):
    """Selection by a ranker fitted on the train split's pairs: weights and accuracy on the other splits."""
    w = World(spark, sf_dir)
    f = retrieval.pool_features(w.pool, w.queries, w.gallery, w.cv, 30)
    names = ["query_label", "example_label", "similarity", "rank_fraction"]
    rows = f.join(w.ranked.select("query_split", "query_idx", "position", "target", "correct"), ["query_split", "query_idx", "position"])
    weights = scorers.fit_pairwise(rows.filter("query_split = 'train'"), names, "target")
    scored = rows.withColumn("score", scorers.linear(F.array(*names), weights))
    from ..operators import evaluate

    best = evaluate.select_best(scored, "score", ["correct"])
    return best.groupBy("query_split").agg(F.count(F.lit(1)).alias("n"), evaluate.share(F.col("correct")).alias("accuracy"))


# Incremental work on orders: the existing table holds every third order, shards bring newer versions.
STORED = """
WITH ex AS (SELECT o_orderkey, o_orderstatus, o_totalprice, -1 AS shard_seq FROM orders WHERE o_orderkey % 3 = 0),
sh AS (SELECT o_orderkey, 'S' || (o_orderkey % 4) AS o_orderstatus, o_totalprice + 1 AS o_totalprice, 0 AS shard_seq FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'T', o_totalprice + 2, 1 FROM orders WHERE o_orderkey % 5 = 0)
"""


def _stored(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    a = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.concat(F.lit("S"), F.col("o_orderkey") % 4).alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(0).alias("shard_seq"))
    b = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("T").alias("o_orderstatus"), (F.col("o_totalprice") + 2).alias("o_totalprice"), F.lit(1).alias("shard_seq"))
    return o, o.filter("o_orderkey % 3 = 0"), a.unionByName(b)


@query(STORED + """, u AS (SELECT * FROM ex UNION ALL SELECT * FROM sh)
SELECT o_orderkey, first(o_orderstatus ORDER BY shard_seq DESC) AS o_orderstatus, round(first(o_totalprice ORDER BY shard_seq DESC), 2) AS o_totalprice FROM u WHERE o_orderkey % 10 <> 0 GROUP BY o_orderkey
""")
def r1_merge(spark, sf_dir):
    o, existing, new = _stored(spark, sf_dir)
    m = integrity.merge(existing, new, ["o_orderkey"], "shard_seq", o.filter("o_orderkey % 10 <> 0"))
    return rounded(m.select("o_orderkey", "o_orderstatus", "o_totalprice"), 2)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 AND o_orderkey % 5 <> 0")
def r2_pending(spark, sf_dir):
    o, existing, new = _stored(spark, sf_dir)
    return integrity.pending(o.select("o_orderkey"), existing.select("o_orderkey").union(new.select("o_orderkey")), ["o_orderkey"])


@query("SELECT l_orderkey, count(*) AS n, count(*) = 4 AS complete FROM lineitem GROUP BY l_orderkey")
def r3_completeness(spark, sf_dir):
    return integrity.completeness(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 4)


@query(STORED + """
SELECT o_orderkey, 'duplicate' AS rule FROM sh GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT DISTINCT o_orderkey, 'outside' FROM sh WHERE o_orderkey % 7 = 0
UNION ALL SELECT DISTINCT sh.o_orderkey, 'changed' FROM sh JOIN orders o ON o.o_orderkey = sh.o_orderkey WHERE sh.o_orderkey % 7 <> 0 AND sh.o_orderstatus <> o.o_orderstatus
""")
def r4_resume_checks(spark, sf_dir):
    o, _, new = _stored(spark, sf_dir)
    return integrity.resume_violations(new, o.filter("o_orderkey % 7 <> 0"), ["o_orderkey"], ["o_orderstatus"])


@query(base() + END + "SELECT query_idx, position, example_idx FROM pools WHERE position >= 20")
def r5_expansion(spark, sf_dir):
    p = World(spark, sf_dir).pool
    return integrity.expansion(p.filter("position < 20"), p, ["query_split", "query_idx"], 20, 30).select("query_idx", "position", "example_idx")


@query(base().replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 17 <> 4)") + END + "SELECT query_split, query_idx, position, example_idx, round(similarity, 6) AS similarity FROM pools WHERE query_split <> 'train'")
def r5_maintained(spark, sf_dir):
    """Pools of a gallery without every ninth row, after those came and every seventeenth went."""
    w = World(spark, sf_dir, ["test", "val"])
    i = F.col("example_idx")
    before, after = w.gallery.filter(i % 9 != 2), w.gallery.filter(i % 17 != 4)
    queries = w.queries.filter(i % 17 != 4)
    stored = scratch.settle(retrieval.top_m(queries, before, 30), "stored")
    added, removed = after.filter(i % 9 == 2), before.filter(i % 17 == 4)
    pools, _ = retrieval.maintained(stored, queries, after, added, removed, 30)
    return rounded(pools.select("query_split", "query_idx", "position", "example_idx", "similarity"))


@query(base() + END + "SELECT query_idx, position FROM pools WHERE position = 3 AND query_idx % 20 = 0")
def r5_prefix_check(spark, sf_dir):
    p = World(spark, sf_dir).pool
    stored = p.withColumn("example_idx", F.when((F.col("position") == 3) & (F.col("query_idx") % 20 == 0), -1).otherwise(F.col("example_idx")))
    return integrity.prefix_violations(stored, p, ["query_split", "query_idx"], 20).select("query_idx", "position")


def _teacher_records(w, k=8):
    s = w.sets.filter(F.col("k") == k).select("query_split", "query_idx", "true_class", "classes")
    key = ["query_split", "query_idx"]
    z = w.zero.select(*key, F.col("scores").alias("zs"))
    p = w.pair.join(s.select(*key, "classes"), key).withColumn("r", S.restrict(F.col("scores"), F.col("classes")))
    p = p.withColumn("mg", S.margin(F.col("r"), S.place_in(F.col("classes"), F.col("true_class"))))
    rows = F.array_sort(F.collect_list(F.struct("position", "example_idx", "class_idx", "r", "mg")))
    c = p.groupBy(*key).agg(rows.alias("x"))
    from ..operators import labelsets

    ranking = labelsets.class_ranking(w.sim).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "class_idx"))).alias("rk"))
    out = s.join(z, key).join(c, key).join(ranking, key)
    return out.select(
        "query_split", "query_idx", "true_class", "classes", F.col("rk.class_idx").alias("ranking"), S.restrict(F.col("zs"), F.col("classes")).alias("zero_scores"),
        F.col("x.example_idx").alias("examples"), F.col("x.class_idx").alias("example_classes"), F.col("x.r").alias("scores"), F.col("x.mg").alias("margins"),
    )


@query("""
SELECT CASE WHEN vec_id % 10 = 0 THEN 'test' WHEN vec_id % 10 = 1 THEN 'val' ELSE 'train' END AS query_split, vec_id AS query_idx, r AS rule
FROM embeddings CROSS JOIN (SELECT unnest(['margins_match', 'pool_size', 'no_self_retrieval']) AS r)
WHERE (r = 'margins_match' AND vec_id % 9 = 0) OR (r = 'pool_size' AND vec_id % 11 = 0) OR (r = 'no_self_retrieval' AND vec_id % 10 > 1 AND vec_id % 13 = 0)
""")
def r6_teacher_validation(spark, sf_dir):
    """Records with planted faults: a shifted margin, a missing candidate, a query among its own candidates."""
    t = _teacher_records(World(spark, sf_dir))
    q = F.col("query_idx")
    t = t.withColumn("margins", F.when(q % 9 == 0, F.transform("margins", lambda m, i: m + F.when(i == 1, 0.1).otherwise(0.0))).otherwise(F.col("margins")))
    for c in ("examples", "example_classes", "scores", "margins"):
        t = t.withColumn(c, F.when(q % 11 == 0, F.slice(c, 1, 29)).otherwise(F.col(c)))
    t = t.withColumn("examples", F.when(q % 13 == 0, F.transform("examples", lambda e, i: F.when(i == 5, q).otherwise(e))).otherwise(F.col("examples")))
    return integrity.validate_teacher(t, 8, 30, N_CLASSES)


RECORD_FAULTS = [
    "label_similarities", "similarities_finite", "similarities_descending", *(f"zero_{n}" for n in integrity.METRICS),
    *(f"candidate_{n}" for n in (*integrity.METRICS, *(f"incremental_{n}" for n in integrity.INCREMENTS))),
]


@query(f"""
SELECT CASE WHEN vec_id % 10 = 0 THEN 'test' WHEN vec_id % 10 = 1 THEN 'val' ELSE 'train' END AS query_split, vec_id AS query_idx, rule
FROM embeddings JOIN (SELECT unnest({RECORD_FAULTS!r}) AS rule, unnest(range({len(RECORD_FAULTS)})) AS i) ON vec_id % {len(RECORD_FAULTS) + 5} = i
""")
def r6_record_validation(spark, sf_dir):
    """Records with one planted fault each, for every rule of values: an infinite or missing number, two swapped similarities, one changed metric."""
    t = scratch.settle(integrity.teacher_metrics(_teacher_records(World(spark, sf_dir)).drop("margins")), "records")
    t = t.withColumn("label_similarities", F.transform("classes", lambda c: 1 / (1.0 + c)))
    t = t.withColumn("similarities", F.transform(F.sequence(F.lit(1), F.size("examples")), lambda i: 1 / (1.0 + i)))
    fault = F.col("query_idx") % (len(RECORD_FAULTS) + 5)
    hit = lambda rule: fault == RECORD_FAULTS.index(rule)

    def wrong(v, kind):
        return ~v if kind == "correct" else v + 1 if kind in ("true_rank", "strongest_wrong") else v + 0.01

    zero = F.struct(*[F.when(hit(f"zero_{n}"), wrong(F.col(f"zero_metrics.{n}"), n)).otherwise(F.col(f"zero_metrics.{n}")).alias(n) for n in integrity.METRICS])
    names = (*integrity.METRICS, *(f"incremental_{n}" for n in integrity.INCREMENTS))
    each = lambda m, i: F.struct(*[F.when(hit(f"candidate_{n}") & (i == 7), wrong(m[n], n)).otherwise(m[n]).alias(n) for n in names])
    at = lambda c, rule, value: F.when(hit(rule), F.transform(c, lambda v, i: F.when(i == 4, value).otherwise(v))).otherwise(F.col(c))
    t = t.withColumns({"zero_metrics": zero, "metrics": F.transform("metrics", each), "label_similarities": at("label_similarities", "label_similarities", F.lit(None).cast("double"))})
    swapped = F.transform("similarities", lambda v, i: F.when(i == 4, 1 / 7.0).when(i == 5, 1 / 6.0).otherwise(v))
    t = t.withColumn("similarities", F.when(hit("similarities_descending"), swapped).when(hit("similarities_finite"), F.transform("similarities", lambda v, i: F.when(i == 0, float("inf")).otherwise(v))).otherwise(F.col("similarities")))
    return integrity.validate_records(t, 8, 30, N_CLASSES)


@query("""
SELECT 'dimensions' AS rule, count(DISTINCT CASE WHEN vec_id % 40 = 7 THEN 63 ELSE 64 END) - 1 AS n FROM embeddings
UNION ALL SELECT 'finite', count(*) FILTER (vec_id % 40 = 9) FROM embeddings
UNION ALL SELECT 'unknown_id', count(*) FILTER (vec_id % 4 <> 0 AND vec_id % 3 = 0) FROM embeddings
UNION ALL SELECT 'empty_pool', count(*) FILTER (vec_id % 10 <= 1 AND vec_id % 4 = 0) FROM embeddings
""")
def r7_table_checks(spark, sf_dir):
    """Tables with planted faults: short vectors, infinite numbers, unknown exemplars, missing pools."""
    w = World(spark, sf_dir)
    i = F.col("example_idx")
    vec = F.when(i % 40 == 7, F.slice("vec", 1, 63)).when(i % 40 == 9, F.transform("vec", lambda v, k: F.when(k == 5, float("inf")).otherwise(v))).otherwise(F.col("vec"))
    first = (F.col("position") == 0) & (F.col("query_idx") % 3 == 0)
    pool = w.pool.filter("query_idx % 4 <> 0").withColumn("example_idx", F.when(first, -1).otherwise(i))
    return integrity.table_violations(w.ex.withColumn("vec", vec), pool)


@query("""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'test' WHEN vec_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM embeddings),
p AS (SELECT *, vec_id % 10 <= 1 AND vec_id % 4 <> 0 AS asked FROM e)
SELECT 'dimensions:image' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'dimensions:text', count(DISTINCT vec_id % 90 = 7) - 1 FROM e
UNION ALL SELECT 'finite:image', count(*) FILTER (vec_id % 40 = 9) FROM e UNION ALL SELECT 'finite:text', 0 UNION ALL SELECT 'label_dimensions', 1
UNION ALL SELECT 'row_counts', count(DISTINCT split) FILTER (vec_id % 50 = 10) FROM e
UNION ALL SELECT 'unknown_query', count(*) FILTER (asked AND (vec_id % 7 = 0 OR vec_id % 50 = 10)) FROM p UNION ALL SELECT 'unknown_id', count(*) FILTER (asked AND vec_id % 3 = 0) FROM p
UNION ALL SELECT 'class_range', count(*) FILTER (asked AND vec_id % 3 = 1) FROM p UNION ALL SELECT 'similarity_finite', count(*) FILTER (asked AND vec_id % 3 = 2) FROM p
UNION ALL SELECT 'target_finite', count(*) FILTER (asked AND vec_id % 5 = 1) FROM p UNION ALL SELECT 'few_candidates', count(*) FILTER (asked AND vec_id % 11 = 0) FROM p
UNION ALL SELECT 'empty_pool', count(*) FILTER (vec_id % 10 <= 1 AND (NOT asked OR vec_id % 7 = 0) AND vec_id % 50 <> 10) FROM p
""")
def r7_dataset_checks(spark, sf_dir):
    """Two families of embeddings, label vectors and pools, with a planted fault for each rule that has one."""
    w = World(spark, sf_dir)
    i, q = F.col("example_idx"), F.col("query_idx")
    image = w.ex.withColumn("vec", F.when(i % 40 == 9, F.transform("vec", lambda v, k: F.when(k == 5, float("nan")).otherwise(v))).otherwise(F.col("vec")))
    brief = w.ex.select("split", "example_idx", F.slice("vec", 1, F.when(i % 90 == 7, 15).otherwise(16)).alias("vec")).filter("example_idx % 50 <> 10")
    labels = w.cv.select("class_idx", F.slice("vec", 1, F.when(F.col("class_idx") == 3, 9).otherwise(16)).alias("vec"))
    pool = w.pool.filter("query_split <> 'train' AND query_idx % 4 <> 0 AND NOT (query_idx % 11 = 0 AND position = 1)").withColumn("target", F.col("similarity") / 2)
    first = lambda rest: (F.col("position") == 0) & rest
    pool = pool.withColumns({
        "example_idx": F.when(first(q % 3 == 0), -1).otherwise(i), "class_idx": F.when(first(q % 3 == 1), N_CLASSES).otherwise(F.col("class_idx")),
        "similarity": F.when(first(q % 3 == 2), float("-inf")).otherwise(F.col("similarity")), "target": F.when(first(q % 5 == 1), F.lit(None)).otherwise(F.col("target")),
        "query_idx": F.when(q % 7 == 0, -q - 1).otherwise(q),
    })
    return integrity.dataset_violations({"image": image.select("split", "example_idx", "vec"), "text": brief}, labels, "text", pool, fewest=30)


@query("""
SELECT o_orderkey, 'stored' AS side FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey <> 0 UNION ALL SELECT -o_orderkey, 'rebuilt' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey <> 0
""")
def r8_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    other = o.select(F.when(F.col("o_orderkey") % 100 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"))
    return integrity.difference(o, other)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN round(o_totalprice, 2) END AS a, CASE WHEN o_orderkey % 70 <> 0 THEN round(o_totalprice + CASE WHEN o_orderkey % 90 = 0 THEN 1 ELSE 0 END, 2) END AS b FROM orders WHERE (o_orderkey % 50 = 0 OR o_orderkey % 70 = 0 OR o_orderkey % 90 = 0) AND NOT (o_orderkey % 50 = 0 AND o_orderkey % 70 = 0)")
def r9_alignment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    other = o.filter("o_orderkey % 70 <> 0").withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 90 == 0, 1).otherwise(0))
    return rounded(integrity.misaligned(o.filter("o_orderkey % 50 <> 0"), other, ["o_orderkey"], "v", 0.5), 2)


@query("SELECT c_mktsegment, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey)) AS fingerprint FROM customer GROUP BY c_mktsegment")
def r10_fingerprint(spark, sf_dir):
    return integrity.fingerprint(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", "c_name")


@query()
def r10_fingerprint_tree(spark, sf_dir):
    return integrity.fingerprint_tree(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", "c_name")


@query()
def r10_fingerprint_large(spark, sf_dir):
    """The order is unique: (order, line)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    return integrity.fingerprint_large(rows, "l_returnflag", "line", "l_partkey")


@query(STORED + "SELECT o_orderkey, first(o_orderstatus ORDER BY shard_seq DESC) AS o_orderstatus, CAST(max(shard_seq) AS INTEGER) AS shard_seq FROM sh GROUP BY o_orderkey")
def r11_shard_stream(spark, sf_dir):
    new = _stored(spark, sf_dir)[2].select("o_orderkey", "o_orderstatus", "shard_seq")
    source, target, marks = (scratch.new(spark, n) for n in ("shards", "merged", "marks"))
    new.repartition(4, "o_orderkey").write.parquet(source)
    shards.merge_stream(spark, source, target, marks, "o_orderkey long, o_orderstatus string, shard_seq int", ["o_orderkey"], "shard_seq")
    return shards.merged(spark, target, ["o_orderkey"], "shard_seq").select("o_orderkey", "o_orderstatus", "shard_seq")


@query(STORED + """SELECT c_custkey, first(o_orderstatus ORDER BY shard_seq DESC, o_orderkey DESC) AS o_orderstatus, first(o_orderkey ORDER BY shard_seq DESC, o_orderkey DESC) AS o_orderkey, CAST(max(shard_seq) AS INTEGER) AS shard_seq
FROM (SELECT o_custkey AS c_custkey, sh.* FROM sh JOIN orders USING (o_orderkey)) GROUP BY c_custkey""")
def r11_stateful_merge(spark, sf_dir):
    """The last record of each customer, kept in the stream's state."""
    o, _, new = _stored(spark, sf_dir)
    of = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = new.join(of, "o_orderkey").select("c_custkey", "shard_seq", "o_orderkey", "o_orderstatus")
    source, seen, marks = (scratch.new(spark, n) for n in ("shards", "progress", "state"))
    rows.repartition(4).write.parquet(source)
    shards.merge_stateful(spark, source, seen, marks, "c_custkey long, shard_seq int, o_orderkey long, o_orderstatus string", ["c_custkey"], "shard_seq")
    return shards.held(spark, marks).select("c_custkey", "o_orderstatus", "o_orderkey", "shard_seq")


@query(base() + END + "SELECT query_split, query_idx, CAST(-1 AS BIGINT) AS stored, example_idx AS rebuilt FROM pools WHERE position = 0 AND query_idx % 30 = 0 AND query_idx % 60 <> 0")
def r12_top1_check(spark, sf_dir):
    p = World(spark, sf_dir).pool
    first = retrieval.top_one(p)
    stored = first.withColumn("example_idx", F.when(F.col("query_idx") % 30 == 0, F.lit(-1).cast("long")).otherwise(F.col("example_idx")))
    return integrity.top1_violations(p, stored, first.filter("query_idx % 60 = 0").select("query_split", "query_idx"))


@query(base() + CAND + END + "SELECT query_idx, position, position < 20 AS reused, round(true_score, 6) AS true_score FROM cand")
def r13_reuse(spark, sf_dir):
    p = World(spark, sf_dir).pair
    keys = ["query_split", "query_idx", "position"]
    x = integrity.reuse(p.drop("scores"), p.filter("position < 20"), p.filter("position >= 20"), keys)
    return rounded(x.select("query_idx", "position", "reused", S.at(F.col("scores"), F.col("true_class")).alias("true_score")))
