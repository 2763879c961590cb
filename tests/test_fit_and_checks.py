"""The pairwise ranker against a general solver, the scorer against plain Python, record and data set rules one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shortlist.operators import evaluate, integrity, scorers

KEY = ["query_split", "query_idx"]


def candidates(spark, n=25, size=14, seed=1):
    rng = random.Random(seed)
    out = []
    for q in range(n):
        for p in range(rng.randint(0, size)):
            x = [rng.gauss(0, s) for s in (1, 3, 0.1)]
            out.append(("train", q, p, *x, 5.0, rng.choice([0.3, math.tanh(x[0] - 0.3 * x[1] + 2 * x[2] + rng.gauss(0, 1))])))
    return spark.createDataFrame(out, "query_split string, query_idx long, position int, a double, b double, c double, same double, target double")


def general(rows, names, ridge):
    """Logistic regression on all pairs as rows."""
    side = lambda s: rows.select(*KEY, F.col("position").alias(f"p{s}"), F.col("target").alias(f"t{s}"), F.array(*names).alias(f"f{s}"))
    p = side("a").join(side("b"), KEY).filter("pa <> pb AND abs(ta - tb) > 0.02")
    data = p.select((F.col("ta") > F.col("tb")).cast("double").alias("label"), array_to_vector(F.zip_with("fa", "fb", lambda x, y: x - y)).alias("features"))
    return LogisticRegression(fitIntercept=False, regParam=ridge, maxIter=200, tol=1e-12).fit(data).coefficients.toArray()


@pytest.mark.parametrize("ridge", [0.01, 1.0])
def test_ranker_equals_a_fit_on_pairs(spark, ridge):
    rows = candidates(spark).repartition(3)
    names = ["a", "b", "c", "same"]
    assert scorers.fit_pairwise(rows, names, "target", ridge=ridge) == pytest.approx(general(rows, names, ridge), abs=1e-5)


def test_ranker_without_pairs(spark):
    assert scorers.fit_pairwise(candidates(spark).filter("position = 0"), ["a", "b"], "target") == [0.0, 0.0]


def test_layers_with_scale_shift_and_exact_gelu(spark):
    rng = np.random.default_rng(2)
    w1, b1, w2, scale, shift = rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=3), rng.normal(size=3)
    x = [[1.0, 2.0, 4.0], [0.0, 0.0, 0.0], [-3.0, 9.0, 0.5]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x array<double>")
    got = {r.i: r.score for r in scorers.two_layer(df, "x", w1, b1, w2, 0.2, scale=scale, shift=shift).collect()}
    for i, v in enumerate(x):
        mean = sum(v) / 3
        z = [(a - mean) / math.sqrt(sum((b - mean) ** 2 for b in v) / 3 + 1e-5) * s + t for a, s, t in zip(v, scale, shift)]
        h = [b1[j] + sum(z[k] * w1[k, j] for k in range(3)) for j in range(4)]
        assert got[i] == pytest.approx(0.2 + sum(a * 0.5 * (1 + math.erf(a / math.sqrt(2))) * w for a, w in zip(h, w2)))
    assert scorers.two_layer(df.filter("i > 9"), "x", w1, b1, w2, 0.2).count() == 0


def good_record(spark):
    s = "query_split string, query_idx long, true_class int, classes array<int>, ranking array<int>, zero_scores array<double>, examples array<long>, example_classes array<int>, scores array<array<double>>, label_similarities array<double>, similarities array<double>"
    row = ("train", 7, 2, [0, 2, 3], [0, 1, 3], [-1.0, -0.5, -2.0], [4, 9], [0, 2], [[-1.0, -2.0, -0.1], [-3.0, -0.2, -0.9]], [0.1, 0.2, -0.3], [0.9, 0.9])
    return integrity.teacher_metrics(spark.createDataFrame([row], s))


FAULTS = {
    "label_count": "array(0, 2) AS classes", "labels_ascending": "array(2, 0, 3) AS classes", "labels_in_range": "array(-1, 2, 3) AS classes",
    "label_similarities": "array(0.1D, double('NaN'), 0.2D) AS label_similarities", "true_class_in_range": "4 AS true_class", "true_class_in_labels": "1 AS true_class",
    "ranking_complete": "array(0, 1) AS ranking", "ranking_in_range": "array(0, 1, 4) AS ranking", "zero_scores_finite": "array(-1.0D, NULL, -2.0D) AS zero_scores",
    "scores_finite": "array(array(-1D, -2D, double('infinity')), array(-3D, -0.2D, -0.9D)) AS scores", "pool_size": "array(4L) AS examples", "candidates_distinct": "array(4L, 4L) AS examples",
    "candidate_classes_in_range": "array(0, 4) AS example_classes", "similarities_finite": "array(0.9D) AS similarities", "similarities_descending": "array(0.8D, 0.9D) AS similarities",
    "no_self_retrieval": "array(7L, 9L) AS examples",
}


def test_every_record_rule_has_its_fault(spark):
    good = good_record(spark)
    assert integrity.validate_records(good, 3, 2, 4).count() == 0
    for rule, fault in FAULTS.items():
        column = fault.split(" AS ")[1]
        bad = good.withColumn(column, F.expr(fault.split(" AS ")[0]).cast(dict(good.dtypes)[column]))
        assert rule in {r.rule for r in integrity.validate_records(bad, 3, 2, 4).collect()}, rule
    for n in integrity.METRICS:
        for c, rule in (("zero_metrics", f"zero_{n}"), ("metrics", f"candidate_{n}")):
            none = lambda m: m.withField(n, F.lit(None).cast(dict(good.select("zero_metrics.*").dtypes)[n]))  # noqa: E731, B023
            bad = good.withColumn(c, none(F.col(c)) if c == "zero_metrics" else F.transform(c, none))
            assert [r.rule for r in integrity.validate_records(bad, 3, 2, 4).collect()] == [rule]
    assert set(integrity.record_rules(3, 2, 4)) == set(FAULTS) | {f"zero_{n}" for n in integrity.METRICS} | {
        f"candidate_{n}" for n in (*integrity.METRICS, *(f"incremental_{n}" for n in integrity.INCREMENTS))
    }


def test_other_temperature(spark):
    warm = integrity.teacher_metrics(good_record(spark).drop("zero_metrics", "metrics"), 2.0)
    assert integrity.validate_records(warm, 3, 2, 4, 2.0).count() == 0 < integrity.validate_records(warm, 3, 2, 4).count()


def test_dataset_rules(spark):
    v = spark.createDataFrame([(s, i, [1.0, 2.0]) for s in ("test", "train") for i in range(3)], "split string, example_idx long, vec array<double>")
    labels = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "class_idx int, vec array<double>")
    schema = "query_split string, query_idx long, example_idx long, class_idx int, similarity double, target double"
    pool = spark.createDataFrame([("test", q, e, e % 2, 0.5, 0.1) for q in range(3) for e in range(2)], schema)
    check = lambda f, l, p, least=2: {r.rule: r.n for r in integrity.dataset_violations(f, l, "t", p, fewest=least).collect() if r.n}  # noqa: E731, E741
    assert check({"i": v, "t": v}, labels, pool) == {}
    assert check({"i": v.filter("example_idx < 2"), "t": v}, labels, pool) == {"row_counts": 2}
    assert check({"i": v.filter("split = 'test'"), "t": v}, labels, pool) == {"row_counts": 1}
    bad = v.withColumn("vec", F.when(F.col("example_idx") == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(None).cast("double"))))
    assert check({"i": bad, "t": v}, labels, pool) == {"dimensions:i": 1, "finite:i": 4}
    assert check({"t": v}, labels.withColumn("vec", F.array(F.lit(1.0))), pool) == {"label_dimensions": 1}
    more = lambda *r: pool.unionByName(spark.createDataFrame([r], schema))
    assert check({"t": v}, labels, more("test", 9, 0, 0, 0.1, 0.1), 1) == {"unknown_query": 1}
    assert check({"t": v}, labels, more("test", 0, 7, 0, 0.1, 0.1)) == {"unknown_id": 1}
    assert check({"t": v}, labels, more("test", 0, 2, -1, 0.1, 0.1)) == {"class_range": 1}
    assert check({"t": v}, labels, more("test", 0, 2, 0, math.nan, None)) == {"similarity_finite": 1, "target_finite": 1}
    assert check({"t": v}, labels, pool, 3) == {"few_candidates": 3}
    assert check({"t": v}, labels, pool.filter("query_idx > 0")) == {"empty_pool": 1}


def test_best_epoch_of_losses(spark):
    values = [(0.9, 1.0), (0.5, 2.0), (0.5, 1.0), (0.5, 3.0), (0.7, 0.0), (0.4, 9.0), (0.6, 0.0)]
    h = spark.createDataFrame([("r", i + 1, a, b) for i, (a, b) in enumerate(values)], "run_id string, epoch int, primary_metric double, secondary_metric double")
    best = lambda patience, *modes: evaluate.best_epochs(h, patience, 1e-12, *modes).first()[1:]
    assert best(9, "min", "min") == (6, None, 7) and best(2, "min", "min") == (3, 5, 5)
    assert best(2, "min", "max") == (6, None, 7) and best(9, "max", "min") == (1, None, 7)
    with pytest.raises(ValueError):
        best(1, "least", "max")
