"""Score vectors, targets, vectors and prompts: literal expectations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.functions import prompts
from shortlist.functions import scores as S
from shortlist.functions import vectors as V


def metrics(spark, scores, true, temperature=1.0):
    df = spark.createDataFrame([(scores, true)], "scores array<double>, true_class int")
    return df.select(S.closed_set(F.col("scores"), F.col("true_class"), temperature).alias("m")).first().m


def test_closed_set(spark):
    m = metrics(spark, [0.0, 2.0, 1.0, -1.0], 2)
    assert (m.predicted, m.correct, m.top5, m.true_rank, m.reciprocal_rank, m.margin) == (1, False, True, 2, 0.5, -1.0)
    assert m.log_probability == pytest.approx(math.log(m.probability))


def test_underflow_keeps_log_probability(spark):
    m = metrics(spark, [0.0, -1000.0], 1)
    assert m.probability == 0.0 and m.log_probability == -1000.0 and m.entropy == pytest.approx(0)


def test_ties_go_to_the_lower_class_and_temperature_leaves_margins(spark):
    assert metrics(spark, [1.0, 1.0], 0).correct and not metrics(spark, [1.0, 1.0], 1).correct
    a, b = metrics(spark, [3.0, 1.0, 2.0], 0), metrics(spark, [3.0, 1.0, 2.0], 0, 5.0)
    assert a.margin == b.margin and a.gap == b.gap and a.probability != b.probability


def test_one_class_has_infinite_margin(spark):
    assert metrics(spark, [1.0], 0).margin == math.inf


def test_restricted_sets(spark):
    rows = [([3.0, 2.0, 4.0, 1.0, 0.0, -1.0], [0, 1]), ([3.0, 2.0, 4.0, 1.0, 0.0, -1.0], [0, 1, 2, 3])]
    df = spark.createDataFrame(rows, "scores array<double>, classes array<int>")
    out = df.select(S.restricted(F.col("scores"), F.col("classes"), F.lit(0)).alias("m")).collect()
    assert [(r.m.correct, r.m.predicted) for r in out] == [(True, 0), (False, 2)]


def test_teacher_and_targets(spark):
    """Metrics and increments against plain Python on drawn scores."""
    rng = random.Random(7)
    zero, rows = [round(rng.uniform(-3, 0), 1) for _ in range(5)], [(i, [round(rng.uniform(-3, 0), 1) for _ in range(5)]) for i in range(12)]
    df = spark.createDataFrame(rows, "position int, scores array<double>").withColumn("m", S.teacher(F.col("scores"), F.lit(3)))
    df = df.withColumn("z", S.teacher(F.array(*map(F.lit, zero)), F.lit(3)))
    margin = lambda v: v[3] - max(x for i, x in enumerate(v) if i != 3)
    kinds = ("incremental_margin", "bounded_margin", "mean_token_probability")
    out = df.select("scores", "m", *[S.target(k, F.col("m"), F.col("z"), 1.7).alias(k) for k in kinds]).collect()
    for r in out:
        v = r.scores
        wrong = max((i for i in range(5) if i != 3), key=lambda i: (v[i], -i))
        before = sum(x > v[3] or (x == v[3] and i < 3) for i, x in enumerate(v))
        assert (r.m.true_rank, r.m.correct, r.m.strongest_wrong) == (before + 1, before == 0, wrong) and r.m.margin == pytest.approx(margin(v))
        assert r.incremental_margin == pytest.approx(margin(v) - margin(zero)) and r.bounded_margin == pytest.approx(1 / (1 + math.exp(-margin(v) / 1.7)))
        assert r.mean_token_probability == pytest.approx(math.exp(v[3]))
    above = df.withColumn("m", S.teacher(F.transform("scores", lambda x: x + 3.5), F.lit(3)))
    with pytest.raises(Exception, match="above 0"):
        above.select(S.target("mean_token_probability", F.col("m"), F.col("z"))).collect()
    with pytest.raises(ValueError):
        S.target("margin", F.col("m"), F.col("z"), temperature=0)


def test_quantization(spark):
    df = spark.createDataFrame([([0.0, -2.0, 1.0],), ([3.0, 4.0, -1.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    df = df.withColumn("scale", V.int8_scale(F.col("v"))).withColumn("q", V.int8_values(F.col("v"), F.col("scale")))
    out = df.select("q", "scale", V.max_error(F.col("v"), V.dequantize(F.col("q"), V.half(F.col("scale")))).alias("e")).collect()
    assert all(r.e < 0.04 for r in out) and list(out[2].q) == [0, 0, 0] and out[2].scale == 1.0
    assert max(abs(x) for r in out for x in r.q) == 127


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=500), rng.normal(size=300) * 1e-6, 2.0 ** np.arange(-26, 16), 65504, 65519, 65520, 70000, 0, 5.9e-8, 2.9e-8, 1.00048828125, 1.0009765625, -3.3]
    out = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", V.half(F.col("x")).alias("h")).collect()
    with np.errstate(over="ignore"):
        assert all(r.h == float(np.float16(r.x)) for r in out)


def test_stored_scale_quantization_equals_numpy(spark):
    v = np.random.default_rng(4).normal(size=(4, 32)).astype(np.float32)
    df = spark.createDataFrame([([float(x) for x in r],) for r in v], "v array<double>")
    df = df.withColumn("scale", V.int8_scale(F.col("v"))).withColumn("stored", V.half(F.col("scale")))
    out = df.select(
        "stored", V.int8_values(F.col("v"), F.col("scale")).alias("q"), V.int8_values(F.col("v"), F.col("stored")).alias("sq"),
        V.dequantize(V.int8_values(F.col("v"), F.col("scale")), F.col("stored")).alias("back"), V.cosine(F.col("v"), V.scaled(V.int8_values(F.col("v"), F.col("stored")), F.col("stored"))).alias("c"),
    ).collect()
    for row, r in zip(v, out):
        scale = np.float32(np.abs(row).max() / np.float32(127))
        stored = np.float16(scale)
        q = np.clip(np.rint(row / scale), -127, 127)
        assert r.stored == float(stored) and list(r.q) == q.tolist() and list(r.sq) == np.clip(np.rint(row / np.float32(stored)), -127, 127).tolist()
        assert list(r.back) == (q.astype(np.float32) * np.float32(stored)).astype(np.float16).astype(float).tolist() and r.c > 0.9999


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.normalise(F.col("a")).alias("n"), V.normalise(F.col("b")).alias("z"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.interaction(F.col("a"), F.col("b")).alias("i")).first()
    assert r.n == [0.6, 0.8] and r.z == [0.0, 0.0] and r.c is None and r.i == [3, 4, 0, 0, 0, 0, 3, 4]


def test_prompts(spark):
    df = spark.createDataFrame([({"B": "quartz", "A": "basalt"}, ["marble"]), ({"B": "quartz", "A": "basalt"}, None)], "o map<string,string>, r array<string>")
    a, b = df.select(prompts.multiple_choice(F.col("o"), F.col("r")).alias("p")).collect()
    assert "below.\nA. basalt\nB. quartz\n\nLabeled reference examples:\n<image>\nReference label: marble\n\n\nClassify" in a.p
    assert "B. quartz\n\nClassify" in b.p and a.p.endswith("option.\n<image>\nAnswer:")
    c, d = df.select(prompts.full_label(F.col("r")).alias("p")).collect()
    assert c.p.endswith("Label: marble\n\nQuery image:\n<image>\nLabel:") and "Labeled" not in d.p and d.p.endswith("label.\n\nQuery image:\n<image>\nLabel:")
    with pytest.raises(Exception, match="blank"):
        df.select(prompts.one_shot(F.lit("  "))).collect()
