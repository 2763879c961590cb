"""Queries for sources, splits and samples, on the larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import evaluate, integrity, sampling
from ..sources import arrays, artifacts, scratch
from .base_sql import CAND, base, metrics
from .fixtures import World, table
from .registry import also, query, r6, rounded, text

SPLIT10 = "CASE WHEN o_orderkey % 10 = 0 THEN 'test' WHEN o_orderkey % 10 = 1 THEN 'val' ELSE 'train' END"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")


def _split(column):
    return F.when(F.col(column) % 10 == 0, "test").when(F.col(column) % 10 == 1, "val").otherwise("train")


@query("""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) - 1 AS BIGINT) AS global_idx FROM orders
""")
def io1_read_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = [o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'")]
    return sampling.read_parts(parts, "o_orderkey").select("o_orderkey", "global_idx")


@query("""
SELECT 'no_embedding' AS rule, count(*) FILTER (vec_id % 7 = 0) AS n FROM embeddings
UNION ALL SELECT 'no_example', count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 100 = 3) FROM embeddings
UNION ALL SELECT 'models', count(DISTINCT CASE WHEN vec_id % 50 = 9 THEN 'n' ELSE 'm' END) - 1 FROM embeddings WHERE vec_id % 7 <> 0
UNION ALL SELECT 'class_order', count(*) FILTER (n_name <> CASE n_nationkey WHEN 3 THEN (SELECT n_name FROM nation WHERE n_nationkey = 4) WHEN 4 THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) ELSE n_name END OR n_nationkey = 7) FROM nation
""")
def io2_alignment(spark, sf_dir):
    """Embeddings with gaps, strangers and two models; class names with two swapped and one missing."""
    e = table(spark, sf_dir, "embeddings")
    model = F.when(F.col("vec_id") % 50 == 9, "n").otherwise("m")
    kept = e.filter("vec_id % 7 <> 0").select("vec_id", model.alias("model_name"))
    found = integrity.alignment(e.filter("vec_id % 7 = 0 OR vec_id % 100 <> 3").select("vec_id"), kept, "vec_id")
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    place = F.when(F.col("n_nationkey") == 3, 4).when(F.col("n_nationkey") == 4, 3).otherwise(F.col("n_nationkey"))
    stored = names.withColumn("n_nationkey", place).filter("n_nationkey <> 7")
    return found.unionByName(integrity.order_violations(stored, names, "n_nationkey", "n_name"))


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dimensions, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings")
def io2_array_files(spark, sf_dir):
    """Embeddings written as array files by all tasks and read again by ranges of rows."""
    arrays.register(spark)
    place = scratch.new(spark, "arrays")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    e.write.format("arrays").mode("append").option("file_rows", 500).save(place)
    back = spark.read.format("arrays").option("part_bytes", 32_000).load(place)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(back.select("vec_id", "label", F.size("embedding").alias("dimensions"), total.alias("total")))


@query(f"SELECT o_orderkey AS global_idx, {SPLIT10} AS split FROM orders")
def io3_split_file(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("global_idx"), _split("o_orderkey").alias("split"))
    place = scratch.new(spark, "split-file")
    artifacts.write_split_parts(o, place)
    return artifacts.read_split_parts(spark, place)


@query(base("train", "val") + CAND + """
x AS (SELECT 1) SELECT query_split, count(*) AS candidates, count(DISTINCT query_idx) AS queries, (SELECT count(*) FROM examples) AS vectors, (SELECT count(*) FROM class_vectors) AS class_vectors FROM cand GROUP BY query_split
""")
def io4_teacher_artifact(spark, sf_dir):
    """Train and val, never test."""
    return _teacher_artifact(spark, World(spark, sf_dir, ["train", "val"]))


also("io4_teacher_artifact_whole", io4_teacher_artifact)


def _teacher_artifact(spark, w):
    place = scratch.new(spark, "teacher")
    c = w.cand.select("query_split", "query_idx", "position", "example_idx", "scores", "margin")
    features = {"vectors": w.ex, "class_vectors": w.cv}
    artifacts.write_teacher(w.zero, c, features, evaluate.teacher_summary(w.cand), place)
    back = spark.read.parquet(f"{place}/candidates").groupBy("query_split").agg(F.count(F.lit(1)).alias("candidates"))
    n = spark.read.parquet(f"{place}/queries").groupBy("query_split").agg(F.count_distinct("query_idx").alias("queries"))
    sizes = [spark.read.parquet(f"{place}/features/{name}").agg(F.count(F.lit(1)).alias(name)) for name in features]
    return back.join(n, "query_split").crossJoin(sizes[0]).crossJoin(sizes[1])  # one row each


@query(base() + metrics("m", "cond", "condition, query_split, query_idx") + """
x AS (SELECT 1) SELECT 'run-1' AS run_id, condition, 'accuracy' AS metric, round(avg(CAST(correct AS DOUBLE)), 6) AS value FROM m GROUP BY condition
""")
def io5_results(spark, sf_dir):
    s = evaluate.summarize(evaluate.measure(World(spark, sf_dir).conditions), ["condition"])
    long = s.select("condition", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    place = artifacts.write_results(long, "run-1", scratch.new(spark, "results"))
    return rounded(spark.read.parquet(f"{place}/metrics").select("run_id", "condition", "metric", "value"))


@query(base() + metrics("m", "cond", "condition, query_split, query_idx") + """
x AS (SELECT 1) SELECT condition, metric, round(value, 6) AS value, (SELECT count(*) FROM m) AS records FROM (
  SELECT condition, unnest(['accuracy', 'mean_margin', 'n']) AS metric, unnest([avg(CAST(correct AS DOUBLE)), avg(margin), CAST(count(*) AS DOUBLE)]) AS value FROM m GROUP BY condition)
""")
def io5_tree_and_records(spark, sf_dir):
    """Metrics as a JSON tree and the records beside it, written and read back."""
    measured = evaluate.measure(World(spark, sf_dir).conditions)
    s = evaluate.summarize(measured, ["condition"]).select("condition", *[F.col(c).cast("double").alias(c) for c in ("accuracy", "mean_margin", "n")])
    place = artifacts.write_results(s.unpivot("condition", ["accuracy", "mean_margin", "n"], "metric", "value"), "run-2", scratch.new(spark, "results"), records=measured)
    n = spark.read.parquet(f"{place}/records").agg(F.count(F.lit(1)).alias("records"))
    return rounded(artifacts.read_tree(spark, place, "condition string").crossJoin(n))  # one row


@query(base() + metrics("m", "cond", "condition, query_split, query_idx") + """
a AS (SELECT * FROM m WHERE condition = 'zero_shot'), b AS (SELECT * FROM m WHERE condition = 'top1')
SELECT a.query_split, a.query_idx, a.true_class, a.predicted AS zero_shot_predicted, a.correct AS zero_shot_correct,
       a.true_rank AS zero_shot_true_rank, round(a.margin, 6) AS zero_shot_margin, b.predicted AS top1_predicted,
       b.correct AS top1_correct, b.true_rank AS top1_true_rank, round(b.margin, 6) AS top1_margin
FROM a JOIN b ON a.query_idx = b.query_idx
""")
def io6_query_csv(spark, sf_dir):
    m = evaluate.measure(World(spark, sf_dir).conditions)
    wide = artifacts.wide_by_condition(m, ["zero_shot", "top1"])
    place = scratch.new(spark, "csv")
    artifacts.write_csv(wide, place)
    return rounded(spark.read.schema(wide.schema).csv(place, header=True))


@query(base() + """
x AS (SELECT 1) SELECT query_split, query_idx, string_agg(CAST(example_idx AS VARCHAR), ',' ORDER BY position) AS examples,
       string_agg(CAST(example_class AS VARCHAR), ',' ORDER BY position) AS classes FROM pools GROUP BY query_split, query_idx
""")
def io7_candidate_export(spark, sf_dir):
    e = artifacts.export_candidates(World(spark, sf_dir).pool, ["example_idx", "class_idx"])
    return e.select("query_split", "query_idx", text("example_idx").alias("examples"), text("class_idx").alias("classes"))


@query(base() + """
x AS (SELECT 1) SELECT query_split, query_idx, string_agg(CAST(example_idx AS VARCHAR), ',' ORDER BY position) AS examples, round(sum(similarity), 5) + 0.0 AS total
FROM pools GROUP BY query_split, query_idx
""")
def io7_array_export(spark, sf_dir):
    """Pools as array files (a row a query, aligned arrays of its candidates), read again by ranges of rows."""
    arrays.register(spark)
    place = scratch.new(spark, "export")
    wide = artifacts.export_candidates(World(spark, sf_dir).pool, ["example_idx", "similarity"])
    wide.write.format("arrays").mode("append").option("file_rows", 200).save(place)
    back = spark.read.format("arrays").option("part_bytes", 20_000).load(place)
    total = F.aggregate("similarity", F.lit(0.0), lambda a, x: a + x)
    return rounded(back.select("query_split", "query_idx", text("example_idx").alias("examples"), total.alias("total")), 5)


@query("""
SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS completed, count(*) AS target, count(*) FILTER (o_orderkey % 3 <> 0) = count(*) AS complete FROM orders
""")
def io8_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return integrity.progress(o.filter("o_orderkey % 3 <> 0"), o, ["o_orderkey"])


@query("""
WITH c AS (SELECT DISTINCT source FROM documents), r AS (
  SELECT source, row_number() OVER (ORDER BY md5(concat_ws(':', '42', source)), source) AS rn, count(*) OVER () AS n FROM c)
SELECT source, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM r
""")
def sp1_class_split(spark, sf_dir):
    return sampling.class_split(table(spark, sf_dir, "documents"), "source", 0.6, 0.2, 42)


@query("""
WITH c AS (SELECT DISTINCT source FROM documents), r AS (
  SELECT source, row_number() OVER (ORDER BY md5(concat_ws(':', '42', source)), source) AS rn, count(*) OVER () AS n FROM c)
SELECT doc_id, source, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS split_idx FROM documents
WHERE source IN (SELECT source FROM r WHERE rn <= floor(n * 0.6))
""")
def sp2_split_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.in_split(d, sampling.class_split(d, "source", 0.6, 0.2, 42), "source", "train", "doc_id").select("doc_id", "source", "split_idx")


@query("""
WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws(':', '7', CAST(c_custkey AS VARCHAR))), c_custkey) AS rn,
                  count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
s AS (SELECT c_custkey, rn, n, greatest(1, round_even(n * 0.7, 0)) AS a, greatest(1, round_even(n * 0.15, 0)) AS b FROM r)
SELECT c_custkey, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + CASE WHEN n - a - b < 1 THEN greatest(0, n - a - 1) ELSE b END THEN 'val' ELSE 'test' END AS split FROM s
""")
def sp3_stratified_split(spark, sf_dir):
    return sampling.stratified_split(_customers(spark, sf_dir), "c_custkey", "c_mktsegment", 0.7, 0.15, 7).select("c_custkey", "split")


@query("""
SELECT 'overlap' AS kind, count(*) FILTER (c_custkey % 50 = 0) AS n FROM customer
UNION ALL SELECT 'missing', count(*) FILTER (c_custkey % 50 = 1) FROM customer UNION ALL SELECT 'unknown', CAST(0 AS BIGINT)
""")
def sp4_verify_split(spark, sf_dir):
    c = _customers(spark, sf_dir).select("c_custkey")
    a = c.filter("c_custkey % 50 <> 1").withColumn("split", F.lit("train"))
    b = c.filter("c_custkey % 50 = 0").withColumn("split", F.lit("test"))
    return sampling.verify_split(a.unionByName(b), "c_custkey", c)


@query(f"""
WITH x AS (SELECT o_orderpriority, {SPLIT10} AS split FROM orders)
SELECT count(*) AS total, count(DISTINCT o_orderpriority) AS classes, count(*) FILTER (split = 'train') AS n_train,
       count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM x
""")
def sp5_split_summary(spark, sf_dir):
    return sampling.split_summary(table(spark, sf_dir, "orders").withColumn("split", _split("o_orderkey")), "o_orderpriority")


RANKED = """
WITH r AS (SELECT {key}, {cls}, row_number() OVER (PARTITION BY {cls} ORDER BY md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR))), {key}) AS rn FROM {table})
"""


@query(RANKED.format(key="o_orderkey", cls="o_orderpriority", seed=3, table="orders") + """
SELECT o_orderkey, o_orderpriority FROM r ORDER BY rn, md5(concat_ws(':', '3', CAST(rn AS VARCHAR), o_orderpriority)), o_orderkey LIMIT 503
""")
def sp6_balanced_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.balanced_sample(o, "o_orderkey", "o_orderpriority", 503, 3)


GIVEN = """,
c AS (SELECT {cls} AS cc, count(*) AS size FROM {table} GROUP BY {cls}),
d AS (SELECT cc, size, {n} * size / CAST(sum(size) OVER () AS DOUBLE) AS due FROM c),
e AS (SELECT cc, size, floor(due) AS fl, due - floor(due) AS rest FROM d),
g AS (SELECT cc, least(size, fl + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, md5(concat_ws(':', '{seed}', cc))) <= {n} - sum(fl) OVER () THEN 1 ELSE 0 END) AS given FROM e)
SELECT {key}, {cls} FROM r JOIN g ON {cls} = cc WHERE rn <= given
"""


@query(RANKED.format(key="c_custkey", cls="c_mktsegment", seed=11, table="customer") + GIVEN.format(key="c_custkey", cls="c_mktsegment", seed=11, table="customer", n="137"))
def sp7_proportional_sample(spark, sf_dir):
    return sampling.proportional_sample(_customers(spark, sf_dir), "c_custkey", "c_mktsegment", 137, 11)


@query(RANKED.format(key="doc_id", cls="lang", seed=5, table="documents") + GIVEN.format(key="doc_id", cls="lang", seed=5, table="documents", n="(SELECT greatest(1, round_even(count(*) * 0.1, 0)) FROM documents)"))
def sp8_learning_curve(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.learning_curve(d, "doc_id", "lang", 5, fraction=0.1)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def sp9_prefix(spark, sf_dir):
    return sampling.prefix(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)
