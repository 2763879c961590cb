"""Evaluation, losses, audit, statistics and integrity: literal expectations."""

import math
import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.functions import stats
from shortlist.operators import audit, evaluate, integrity, pairs, scorers
from shortlist.streaming import shards


def test_mcnemar(spark):
    """Against the tail of the binomial distribution in whole numbers, and on counts too large for it."""

    def tail(a, b):
        n, low = a + b, min(a, b)
        return min(Fraction(1), Fraction(2 * sum(math.comb(n, i) for i in range(low + 1)), 2**n)) if n else Fraction(1)

    rng = random.Random(4)
    counts = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(0, n) for n in range(8)] + [(n, n) for n in range(6)]
    got = spark.createDataFrame(counts, "a long, b long").select("a", "b", stats.mcnemar("a", "b").alias("p")).collect()
    assert all(r.p == pytest.approx(float(tail(r.a, r.b)), rel=1e-9) for r in got)
    far = spark.createDataFrame([(4100, 3300), (2000, 2000)], "a long, b long").select(stats.mcnemar("a", "b").alias("p")).collect()
    assert 0 <= far[0].p < 1e-15 and far[1].p == 1


def test_bootstrap_brackets_the_difference(spark):
    c = spark.createDataFrame([("a", 500, 80, 40)], "k string, n long, treatment_only long, control_only long")
    a, b = (stats.bootstrap(c, ["k"]).first() for _ in range(2))
    assert a == b and a.low < 0.08 < a.high


def test_bootstrap_interval_has_the_quantiles_of_the_multinomial(spark):
    """The drawn bounds lie where the exact distribution of the resampled difference has its 2.5 % and 97.5 %."""
    for n, a, b in ((40, 11, 4), (25, 3, 3), (60, 0, 9)):
        exact = {}
        for i in range(n + 1):
            for j in range(n + 1 - i):
                p = math.comb(n, i) * math.comb(n - i, j) * (a / n) ** i * (b / n) ** j * ((n - a - b) / n) ** (n - i - j)
                exact[i - j] = exact.get(i - j, 0) + p
        below = lambda x: sum(p for d, p in exact.items() if d <= round(x * n, 6))  # noqa: E731, B023
        r = stats.bootstrap(spark.createDataFrame([("k", n, a, b)], "k string, n long, treatment_only long, control_only long"), ["k"]).first()
        for bound, share in ((r.low, 0.025), (r.high, 0.975)):
            step = 1 / n
            assert below(bound - step) - 0.01 <= share <= below(bound) + 0.01, (n, a, b, bound)


def test_oracle_summary(spark):
    rows = []
    for q, true, classes, correct, margin, rank in (
        (0, 1, (2, 1), {4: (False, True), 8: (False, False)}, {4: (-1, 0.5), 8: (-2, -0.2)}, {4: (3, 1), 8: (5, 2)}),
        (1, 3, (3, 4), {4: (True, False), 8: (True, False)}, {4: (0.7, -1), 8: (0.2, -1.5)}, {4: (1, 4), 8: (1, 6)}),
    ):
        for k in (4, 8):
            for i in (0, 1):
                rows.append(("test", q, true, i, q * 10 + 10 + i, classes[i], k, correct[k][i], float(margin[k][i]), rank[k][i]))
    df = spark.createDataFrame(rows, "query_split string, query_idx long, true_class int, position int, example_idx long, class_idx int, k int, correct boolean, margin double, true_rank int")
    out = {r.k: r for r in evaluate.oracle_summary(df).collect()}
    assert out[4].oracle_accuracy == 1 and out[8].oracle_accuracy == 0.5 and out[4].top1_accuracy == 0.5 and out[4].pool_has_true_rate == 1
    first = {r.query_idx: r.example_idx for r in evaluate.first_success(df.filter("k = 8")).collect()}
    assert first == {0: None, 1: 20}
    curve = [r.accuracy for r in evaluate.oracle_curve(df.filter("k = 4"), 2).orderBy("candidates").collect()]
    assert curve == [0.5, 1.0]


def test_monotonicity_and_paired(spark):
    rows = [("t", 0, "a", k, (c, 1.0, -1.0)) for k, c in ((2, True), (4, False), (8, True))]
    df = spark.createDataFrame(rows, "query_split string, query_idx long, condition string, k int, m struct<correct boolean, margin double, log_probability double>")
    assert evaluate.monotonicity_violations(df).select("k").collect()[0].k == 8


def test_choice_trials(spark):
    rows = [(1, 0, 0, "A", True, "A"), (1, 1, 1, "B", False, "A"), (2, 0, 0, "B", True, "B"), (2, 1, 1, "A", True, "A")]
    clip = [(1, 0, 0, "A", False, "B"), (1, 1, 1, "B", True, "B"), (2, 0, 0, "B", True, "B"), (2, 1, 1, "A", False, "B")]
    data = [("zero", 4, *r, "test") for r in rows] + [("clip", 4, *r, "test") for r in clip] + [("none", 4, 1, 0, 0, "A", None, None, "test")]
    df = spark.createDataFrame(data, "condition string, k int, letter_seed int, query_idx long, true_class int, true_letter string, correct boolean, pred_letter string, query_split string")
    out = evaluate.choice_summary(df).filter("condition = 'clip'").collect()
    assert {r.letter_seed: r.accuracy for r in out if r.letter_seed} == {1: 0.5, 2: 0.5}
    assert {r.true_letter: r.accuracy for r in out if r.true_letter} == {"A": 0, "B": 1}
    assert [(r.pred_letter, r.n) for r in out if r.pred_letter] == [("B", 4)]
    assert evaluate.choice_summary(df).filter("condition = 'none'").count() == 0
    d = evaluate.clustered_difference(df, "clip", "zero").first()
    assert d.difference == -0.25 and d.clusters == 2 and d.trials == 4
    both = df.unionByName(df.withColumn("query_split", F.lit("val")))  # equal ids in another split are other queries
    d = evaluate.clustered_difference(both, "clip", "zero").first()
    assert d.difference == -0.25 and d.clusters == 4 and d.trials == 8
    assert sum(r.both + r.treatment_only + r.control_only + r.neither for r in evaluate.seed_transitions(both, "clip", "zero").collect()) == 8
    x = both.filter("condition = 'zero'").withColumns({"pool_has_true": F.col("query_split") == "test", "top1_in_options": F.lit(True), "top1_same_class": F.lit(False)})
    r = evaluate.first_trial_rates(x).first()
    assert (r.trials, r.queries, r.seeds, r.pool_has_true_rate) == (8, 4, 2, 0.5)


CAND = "query_split string, query_idx long, position int, score double, target double, correct boolean, margin double"


def cand(spark, rows):
    return spark.createDataFrame([("t", q, i, float(s), float(t), c, float(t)) for q, i, s, t, c in rows], CAND)


def test_pairwise_losses(spark):
    """Scores in the order of the targets lose less than in any other order, and only pairs beyond the gap count."""
    targets = [0.1, 0.75, 0.4, 0.9]
    loss = {}
    for order in permutations([-1.5, -0.2, 0.8, 2.6]):
        rows = [(0, i, s, t, t > 0.5) for i, (s, t) in enumerate(zip(order, targets))]
        x = cand(spark, rows)
        loss[order] = pairs.pairwise_loss(x).first().loss
        if order in ((-1.5, 0.8, -0.2, 2.6), (2.6, -0.2, 0.8, -1.5)):
            assert pairs.pairwise_accuracy(x).first().asDict() == {"pairs": 6, "accuracy": 1.0 if order[0] < 0 else 0.0}
    assert min(loss, key=loss.get) == (-1.5, 0.8, -0.2, 2.6) and max(loss, key=loss.get) == (2.6, -0.2, 0.8, -1.5)
    near = cand(spark, [(0, i, i, 0.3 + 0.004 * i, False) for i in range(5)])  # 0.016 apart at most
    assert pairs.pairwise_loss(near).first().asDict() == {"pairs": 0, "loss": 0} and pairs.pairwise_accuracy(near).first().accuracy is None
    assert pairs.pairwise_loss(near, min_gap=0.01).first().pairs == 3
    heavy = cand(spark, [(0, 0, 4, 0.95, True), (0, 1, -2, 0.35, False), (0, 2, 1, 0.05, False)])  # right where it matters, wrong at the end
    assert pairs.weighted_pairwise_loss(heavy, 0.1).first().loss < pairs.pairwise_loss(heavy).first().loss


def test_listwise_and_hybrid(spark):
    x = cand(spark, [(0, i, 0, 0, i < 2) for i in range(4)] + [(1, i, 0, 0, False) for i in range(4)])
    assert pairs.listwise_loss(x).first().loss == pytest.approx(math.log(2))
    h = cand(spark, [(0, 0, 0, 2, True), (0, 1, 0, 0, False), (0, 2, 0, -1, False)])
    assert pairs.hybrid_listwise_loss(h, 0.25).first().loss == pytest.approx(math.log(2) + 0.25 * math.log(3))
    assert pairs.crossing_loss(x.filter("query_idx = 1")).first().loss == 0
    with pytest.raises(Exception, match="outside"):
        pairs.bce_loss(cand(spark, [(0, 0, 0, 2, True)])).collect()


def test_correlations(spark):
    x = cand(spark, [(0, 0, 1, 1, True), (0, 1, 2, 2, True), (0, 2, 3, 3, True), (1, 0, 1, 1, True), (1, 1, 1, 1, True), (2, 0, 1, 2, True), (2, 1, 1, 3, True), (3, 0, 1, 3, True), (3, 1, 2, 1, True), (3, 2, 2, 2, True)])
    s = {r.query_idx: r.spearman for r in pairs.spearman(x, "score", "target").collect()}
    k = {r.query_idx: r.kendall for r in pairs.kendall(x, "score", "target").collect()}
    assert s[0] == pytest.approx(1) and k[0] == pytest.approx(1) and s[1] == k[1] == 1 and s[2] == k[2] == 0
    assert s[3] == pytest.approx(-0.8660254) and k[3] == pytest.approx(-0.8164966)


def audited(scores, true, classes):
    """Coverage, chosen and best candidate, and regret by plain loops."""
    margin = lambda v, some: v[true] - max(v[c] for c in some if c != true)
    every = range(len(scores[0]))
    full, part = [margin(v, every) for v in scores], [margin(v, classes) for v in scores]
    wrong = [max((c for c in every if c != true), key=lambda c: (v[c], -c)) for v in scores]
    pick, best = (max(range(len(scores)), key=lambda i: (m[i], -i)) for m in (part, full))
    return sum(w in classes for w in wrong) / len(wrong), pick, best, full[best] - full[pick]


def test_audit_equals_plain_loops_and_finds_counterexamples(spark):
    """Among drawn score tables are some where a set of classes picks another candidate than all classes do."""
    rng = random.Random(12)
    rows, want, picks = [], {2: [], 3: [], 5: []}, 0
    for q in range(30):
        scores = [[round(rng.gauss(0, 2), 2) for _ in range(5)] for _ in range(4)]
        true, ranking = q % 5, [c for c in range(5) if c != q % 5]
        rng.shuffle(ranking)
        for k in want:
            classes = sorted([true, *ranking[: k - 1]])
            want[k].append(audited(scores, true, classes))
            picks += want[k][-1][1] != want[k][-1][2]
            rows.append((q, true, k, classes, scores))
    assert picks > 5 and all(w[1] == w[2] and w[0] == 1 and w[3] == 0 for w in want[5])
    c = spark.createDataFrame([("v", q, t, i, v) for q, t, k, _, scores in rows if k == 2 for i, v in enumerate(scores)], "query_split string, query_idx long, true_class int, position int, scores array<double>")
    s = spark.createDataFrame([("v", q, k, classes) for q, _, k, classes, _ in rows], "query_split string, query_idx long, k int, classes array<int>")
    out = {r.k: r for r in audit.audit_summary(audit.audit_rows(c, s)).collect()}
    for k, w in want.items():
        assert out[k].coverage == pytest.approx(sum(x[0] for x in w) / 30) and out[k].top_agreement == pytest.approx(sum(x[1] == x[2] for x in w) / 30)
        assert out[k].mean_regret == pytest.approx(sum(x[3] for x in w) / 30) and out[k].median_regret == pytest.approx(float(np.median([x[3] for x in w])))
        assert out[k].p95_regret == pytest.approx(float(np.quantile([x[3] for x in w], 0.95)))
    assert out[5].mean_spearman == pytest.approx(1) and out[5].mean_kendall == pytest.approx(1) and out[2].mean_spearman < 1


def test_selection_metrics(spark):
    x = spark.createDataFrame([("t", 0, 0, 0.1, 0.2, False, -1.0), ("t", 0, 1, 0.9, 0.8, True, 2.0)], CAND)
    r = evaluate.selection_metrics(x, "score", "target").first()
    assert r.selected_accuracy == 1 and r.mean_margin_regret == 0 and r.margin_agreement == 1 and r.target_agreement == 1
    assert r.mean_margin_spearman == pytest.approx(1) and evaluate.selection_metrics(x.filter("position = 0"), "score", "target").first().mean_margin_spearman == 0


def test_teacher_summary_and_distributions(spark):
    m = "struct<correct boolean, margin double, probability double, log_probability double>"
    rows = [
        ("train", 5, 0, 0, 0, (True, 1.0, 0.5, -0.7), (False, -0.5, 0.2, -1.6)), ("train", 5, 0, 1, 1, (False, -1.0, 0.1, -2.3), (False, -0.5, 0.2, -1.6)),
        ("val", 5, 1, 0, 1, (False, -1.0, 0.3, -1.2), (True, 0.5, 0.4, -0.9)), ("val", 5, 1, 1, 1, (True, 2.0, 0.8, -0.2), (True, 0.5, 0.4, -0.9)),
    ]
    c = spark.createDataFrame(rows, f"query_split string, query_idx long, true_class int, position int, class_idx int, m {m}, z {m}")
    out = {r.query_split: r for r in evaluate.teacher_summary(c).collect()}
    assert out["train"].zero_accuracy == 0 and out["train"].contrastive_rate == 1 and out["train"].oracle_at_top1 == 1 and out["val"].oracle_at_top1 == 0
    assert out["val"].any_correct == 1 and out["train"].pairs == 2 and out["train"].positive_increment_rate == 0.5
    d = {(r.query_split, r.column): r for r in evaluate.teacher_distributions(c).collect()}
    assert len(d) == 10 and d["train", "incremental_margin"].mean == pytest.approx(0.5) and d["val", "incremental_true_probability"].max == pytest.approx(0.4)
    counts = evaluate.scoring_counts(spark.createDataFrame([("a", 8), ("a", 4), ("b", 8)], "mode string, size int"), ["mode", "size"])
    assert {(r.field, r.value): r.n for r in counts.collect()} == {("mode", "a"): 2, ("mode", "b"): 1, ("size", "8"): 2, ("size", "4"): 1}


def report(spark, rr):
    zero = [0.0, 0.0, 1.0]
    picks = [(0, 0, 10, 2, [0.0, -1.0, 0.5], 11, 0, rr, True), (1, 1, 12, 1, [0.0, 0.8, 0.1], 12, 1, [0.0, 0.8, 0.1], True), (2, 0, 13, 2, [0.1, 0.0, 0.9], 14, 1, [0.2, 0.6, 0.3], False)]
    scored = [("test", q, t, "zero_shot", zero) for q, t, *_ in picks]
    chosen = []
    for q, t, e1, c1, s1, e2, c2, s2, has in picks:
        scored += [("test", q, t, "top1", s1), ("test", q, t, "rr", s2)]
        chosen += [("test", q, t, "top1", 0, e1, c1, has, s1[t] == max(s1)), ("test", q, t, "rr", 1 if e1 != e2 else 0, e2, c2, has, s2[t] == max(s2))]
    sd = spark.createDataFrame(scored, "query_split string, query_idx long, true_class int, condition string, scores array<double>")
    cd = spark.createDataFrame(chosen, "query_split string, query_idx long, true_class int, selector string, position int, example_idx long, class_idx int, pool_has_true boolean, correct boolean")
    sets = spark.createDataFrame([("test", q, 2, sorted({t, 2})) for q, t, *_ in picks], "query_split string, query_idx long, k int, classes array<int>")
    return {(r.condition, r.k, r.metric): r.value for r in evaluate.held_out_report(sd, sets, cd, "top1", "zero_shot", 500).collect()}


def test_held_out_report(spark):
    r = report(spark, [0.9, 0.1, 0.0])
    assert (r["rr", None, "accuracy"], r["top1", None, "accuracy"], r["zero_shot", None, "accuracy"]) == pytest.approx((2 / 3, 1 / 3, 0))
    assert (r["rr", None, "paired_difference"], r["rr", None, "paired_treatment_only"], r["rr", None, "paired_control_only"]) == pytest.approx((1 / 3, 1, 0))
    assert r["rr", None, "paired_low"] <= 1 / 3 <= r["rr", None, "paired_high"] and r["top1", None, "paired_difference"] == pytest.approx(1 / 3)
    assert (r["rr", None, "selection_same_class_rate"], r["rr", None, "selection_agreement"], r["rr", None, "selection_pool_has_true_rate"]) == pytest.approx((2 / 3, 1 / 3, 2 / 3))
    assert (r["rr", None, "selection_accuracy_has"], r["top1", None, "selection_accuracy_has"], r["rr", None, "selection_accuracy_lacks"]) == (1, 0.5, 0)
    assert r["all", None, "distinct_exemplars"] == pytest.approx(5 / 3) and r["rr", 2, "accuracy"] == pytest.approx(2 / 3) and ("top1", 2, "paired_p") in r


def test_best_epoch(spark):
    h = spark.createDataFrame([(1, e, p, s) for e, p, s in ((1, 0.5, 0.1), (2, 0.5, 0.2), (3, 0.4, 0.9), (4, 0.4, 0.9), (5, 0.9, 0.9))], "run_id long, epoch int, primary_metric double, secondary_metric double")
    r = evaluate.best_epochs(h, 2).first()
    assert (r.best_epoch, r.stop_epoch) == (2, 4)
    assert evaluate.best_epochs(h, 9).first().best_epoch == 5
    near = spark.createDataFrame([(1, 1, 0.5, 0.1), (1, 2, 0.5 + 4e-13, 0.05), (1, 3, 0.5 - 4e-13, 0.2), (1, 4, 0.5 - 4e-12, 0.9)], h.schema)
    assert evaluate.best_epochs(near, 9).first().best_epoch == 3  # a greater primary metric wins by any amount, ties are within the tolerance


def test_merge_and_resume(spark):
    s = "id long, v string, seq long"
    old, new = spark.createDataFrame([(22, "old", 0)], s), spark.createDataFrame([(33, "a", 0), (11, "b", 0), (44, "c", 1), (11, "d", 1), (99, "x", 1)], s)
    want = spark.createDataFrame([(i,) for i in (11, 22, 33, 44)], "id long")
    got = {r.id: r.v for r in integrity.merge(old, new, ["id"], "seq", want).collect()}
    assert got == {11: "d", 22: "old", 33: "a", 44: "c"}
    bad = integrity.resume_violations(new, want.withColumn("v", F.lit("a")), ["id"], ["v"]).collect()
    assert {(r.id, r.rule) for r in bad} == {(11, "duplicate"), (99, "outside"), (11, "changed"), (44, "changed")}
    assert {r.id for r in integrity.pending(want, new, ["id"]).collect()} == {22}


def test_prefix_and_expansion(spark):
    s = "q long, position int, example_idx long, similarity double"
    pool = spark.createDataFrame([(0, i, 10 + i, 0.9 - i / 10) for i in range(4)], s)
    assert integrity.prefix_violations(pool.filter("position < 3"), pool, ["q"], 3).count() == 0
    changed = pool.withColumn("example_idx", F.when(F.col("position") == 1, 99).otherwise(F.col("example_idx")))
    assert integrity.prefix_violations(changed, pool, ["q"], 3).count() == 1
    assert [r.position for r in integrity.expansion(pool.filter("position < 3"), pool, ["q"], 3, 4).collect()] == [3]
    with pytest.raises(ValueError):
        integrity.expansion(pool, pool, ["q"], 4, 3)


def test_mean_log_likelihood(spark):
    t = spark.createDataFrame([(0, -1.0), (0, -3.0)], "label int, logprob double")
    labels = spark.createDataFrame([(0,), (1,)], "label int")
    got = {r.label: r.score for r in scorers.mean_log_likelihood(t, labels, ["label"]).collect()}
    assert got == {0: -2.0, 1: -math.inf}


def test_stream_merges_growing_shards(spark, tmp_path):
    s = "id long, v string, seq int"
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    spark.createDataFrame([(1, "a", 0), (2, "b", 0)], s).write.parquet(source)
    shards.merge_stream(spark, source, target, marks, s, ["id"], "seq")
    spark.createDataFrame([(2, "c", 1), (3, "d", 1)], s).write.mode("append").parquet(source)
    shards.merge_stream(spark, source, target, marks, s, ["id"], "seq")
    assert {r.id: r.v for r in shards.merged(spark, target, ["id"], "seq").collect()} == {1: "a", 2: "c", 3: "d"}
    assert max(r.completed for r in shards.progress(spark, target, ["id"]).collect()) == 3


def test_stateful_merge_goes_on_after_a_restart(spark, tmp_path):
    """Late, repeated and null records over several calls: state holds the last of each key, the count never falls."""
    s = "id long, v string, seq int"
    source, seen, marks = (str(tmp_path / n) for n in ("in", "progress", "state"))
    rounds = [[(1, "a", 0), (2, "b", 5), (None, "n", 1)], [(1, "c", 2), (3, "d", 0), (2, "late", 4)], [(1, "older", 1), (3, "e", 0), (3, None, 0), (None, "m", 2)], [(1, "c", 2)]]
    last, counts = {}, []
    for i, rows in enumerate(rounds):
        spark.createDataFrame(rows, s).repartition(2).write.mode("append").parquet(source)
        for k, v, q in rows:
            if k not in last or (q, v is not None, v or "") > (last[k][1], last[k][0] is not None, last[k][0] or ""):
                last[k] = (v, q)
        shards.merge_stateful(spark, source, seen, marks, s, ["id"], "seq")
        assert {r.id: (r.v, r.seq) for r in shards.held(spark, marks).collect()} == last
        counts = [r.completed for r in shards.completed(spark, seen).orderBy("batch").collect()]
        assert counts == sorted(counts) and counts[-1] == len(last)
    assert len(counts) >= len(rounds)
    shards.merge_stateful(spark, source, seen, marks, s, ["id"], "seq")  # nothing new
    assert [r.completed for r in shards.completed(spark, seen).orderBy("batch").collect()] == counts


def test_validation_of_tables_and_records(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    e = spark.createDataFrame([(2, "m"), (3, "n"), (4, "m")], "id long, model_name string")
    assert {r.rule: r.n for r in integrity.alignment(a, e, "id").collect()} == {"no_embedding": 1, "no_example": 1, "models": 1}
    names = lambda x: spark.createDataFrame(list(enumerate(x)), "i int, name string")
    assert integrity.order_violations(names("abc"), names("acbd"), "i", "name").first().n == 3 and integrity.order_violations(names("ab"), names("ab"), "i", "name").first().n == 0
    v = spark.createDataFrame([("train", 0, [1.0, 2.0]), ("test", 0, [1.0, 2.0]), ("test", 1, [math.inf, 1.0]), ("val", 1, [1.0])], "split string, example_idx long, vec array<double>")
    pool = spark.createDataFrame([("test", 0, 0), ("test", 1, 7)], "query_split string, query_idx long, example_idx long")
    assert {r.rule: r.n for r in integrity.table_violations(v, pool).collect()} == {"dimensions": 1, "finite": 1, "unknown_id": 1, "empty_pool": 1}
    x, y = (spark.createDataFrame([(i,) for i in r], "id long") for r in ([1, 1, 2], [1, 2, 3]))
    assert sorted((r.id, r.side) for r in integrity.difference(x, y).collect()) == [(1, "stored"), (3, "rebuilt")]
    s = "query_split string, query_idx long, true_class int, classes array<int>, ranking array<int>, zero_scores array<double>, examples array<long>, example_classes array<int>, scores array<array<double>>, margins array<double>"
    good = ("train", 5, 0, [0, 1, 2], [1, 2, 3], [2.0, 2.5, 0.0], [10, 11], [0, 1], [[3.0, 2.0, 0.0], [2.0, 3.0, 0.0]], [1.0, -1.0])
    bad = [(*good[:1], 6, *good[2:9], [1.1, -1.0]), (*good[:1], 7, 3, *good[3:]), (*good[:1], 10, *good[2:]), (*good[:1], 8, *good[2:5], [2.0, math.inf, 0.0], *good[6:])]
    out = {(r.query_idx, r.rule) for r in integrity.validate_teacher(spark.createDataFrame([good, *bad], s), 3, 2, 4).collect()}
    assert {(6, "margins_match"), (7, "true_class_in_labels"), (10, "no_self_retrieval"), (8, "zero_scores_finite")} <= out and not any(i == 5 for i, _ in out)


def test_scorers(spark):
    x = spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (1, [0.0, 0.0, 0.0])], "i int, x array<double>")
    w1, b1, w2 = np.eye(3), np.zeros(3), np.array([1.0, 0.0, -1.0])
    got = {r.i: r.score for r in scorers.two_layer(x, "x", w1, b1, w2, 0.5).collect()}
    z = (np.array([1.0, 2.0, 4.0]) - 7 / 3) / math.sqrt(np.var([1.0, 2.0, 4.0]) + 1e-5)
    gelu = lambda h: 0.5 * h * (1 + math.erf(h / math.sqrt(2)))
    assert got[0] == pytest.approx(gelu(z[0]) - gelu(z[2]) + 0.5) and got[1] == pytest.approx(0.5)
    rng = np.random.default_rng(2)
    rows = [("train", q, p, *map(float, f), float(2 * f[0] - f[1])) for q in range(30) for p, f in enumerate(rng.normal(size=(5, 2)))]
    w = scorers.fit_pairwise(spark.createDataFrame(rows, "query_split string, query_idx long, position int, a double, b double, target double"), ["a", "b"], "target")
    assert w[0] > 0 > w[1] and w[0] / -w[1] == pytest.approx(2, rel=0.2)


def test_results_survive_json(spark, tmp_path):
    from shortlist.sources import artifacts

    long = spark.createDataFrame([("zero_shot", 4, "accuracy", 0.5), ("zero_shot", 4, "odd", math.nan), ("top1", 4, "accuracy", 1.0)], "condition string, k int, metric string, value double")
    place = artifacts.write_results(long, "r", str(tmp_path), complete=False, records=spark.createDataFrame([(1, True)], "id long, correct boolean"), keys=["condition", "k"])
    got = {(r.condition, r.k, r.metric): r.value for r in artifacts.read_tree(spark, place, "condition string, k int").collect()}
    assert place.endswith("-partial") and got == {("zero_shot", 4, "accuracy"): 0.5, ("zero_shot", 4, "odd"): None, ("top1", 4, "accuracy"): 1.0}
    assert spark.read.parquet(f"{place}/records").first().run_id == "r" and spark.read.parquet(f"{place}/metrics").count() == 3
