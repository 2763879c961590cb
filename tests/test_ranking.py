"""Rank statistics and pair sums of lists: against all pairs, with ties and lists of any length."""

import math
import random
import time
from itertools import combinations

import numpy as np
import pytest

from shortlist.functions import ranking
from shortlist.operators import pairs


def sign(x):
    return (x > 0) - (x < 0)


def tau_b(a, b):
    p = list(combinations(range(len(a)), 2))
    up = [(sign(a[i] - a[j]), sign(b[i] - b[j])) for i, j in p]
    d = math.sqrt(sum(x != 0 for x, _ in up)) * math.sqrt(sum(y != 0 for _, y in up))
    return sum(x * y for x, y in up) / d if d else math.nan


def rho(a, b):
    rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    if len(set(a)) < 2 or len(set(b)) < 2:
        return math.nan
    return float(np.corrcoef(rank(a), rank(b))[0, 1])


def many(seed=1):
    rng = random.Random(seed)
    sizes = [0, 1, 2, 2, 3, 7, 30, 0, 120]
    return [([rng.choice([1, 2, 2.5, -3, 0]) if rng.random() < 0.5 else rng.random() for _ in range(n)], [rng.randint(0, n) / 3 for _ in range(n)]) for n in sizes] + [([1.0] * 5, [1.0, 2.0, 3.0, 1.0, 2.0])]


def flat(listed):
    row = np.repeat(np.arange(len(listed)), [len(a) for a, _ in listed])
    return row, *(np.array([x for r in listed for x in r[i]], float) for i in (0, 1))


def test_correlations_of_many_lists():
    listed = many()
    row, a, b = flat(listed)
    assert ranking.kendall(row, a, b, len(listed)) == pytest.approx([tau_b(*r) for r in listed], nan_ok=True)
    assert ranking.spearman(row, a, b, len(listed)) == pytest.approx([rho(*r) for r in listed], nan_ok=True)
    assert len(ranking.kendall(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0)) == 0


@pytest.mark.parametrize("gap", [0.0, 0.02, 0.34, 5.0])
def test_pair_counts(gap, monkeypatch):
    monkeypatch.setattr(ranking, "STEP", 50)
    listed = many(3)
    row, s, t = flat(listed)
    n, right = ranking.ordered_pairs(row, s, t, gap, len(listed))
    each = [[(i, j) for i, j in combinations(range(len(t)), 2) if abs(t[i] - t[j]) > gap] for _, t in listed]
    assert n.tolist() == [len(p) for p in each]
    assert right.tolist() == [sum(sign(s[i] - s[j]) == sign(t[i] - t[j]) for i, j in p) for p, (s, t) in zip(each, listed)]
    met = [(int(i), int(j)) for a, b in ranking.pair_blocks(row, len(listed)) for i, j in zip(a, b)]
    assert met == [(i, j) for i, j in combinations(range(len(row)), 2) if row[i] == row[j]]


def test_a_long_list_takes_seconds():
    rng = np.random.default_rng(1)
    n = 1_000_000
    a, row = rng.integers(0, n // 2, n).astype(float), np.zeros(n, np.int64)
    began = time.time()
    assert ranking.kendall(row, a, a, 1)[0] == pytest.approx(1) and ranking.spearman(row, a, -a, 1)[0] == pytest.approx(-1)
    assert ranking.kendall(row, a, rng.random(n), 1)[0] == pytest.approx(0, abs=0.01)
    few, right = ranking.ordered_pairs(row, a, a, 0.5, 1)
    assert few[0] == right[0] > n * (n - 1) // 2 - 2 * n
    assert time.time() - began < 60


def test_groups_of_thousands_in_spark(spark):
    """Lists of 4,000 and more, in one query and over several."""
    rng = random.Random(5)
    rows = [("test", q, i, float(rng.randint(0, 900)), rng.random()) for q, n in ((0, 4000), (1, 3), (2, 2500)) for i in range(n)]
    df = spark.createDataFrame(rows, "query_split string, query_idx long, position int, score double, target double")
    got = {r.query_idx: r for r in pairs.correlations(df, "score", "target").collect()}
    for q in (0, 1, 2):
        a, b = ([r[i] for r in rows if r[1] == q] for i in (3, 4))
        assert got[q].n == len(a)
        want = ranking.kendall(np.zeros(len(a), np.int64), np.array(a), np.array(b), 1)[0]
        assert got[q].kendall == pytest.approx(want)
    assert tau_b(*[[r[i] for r in rows if r[1] == 1] for i in (3, 4)]) == pytest.approx(got[1].kendall)


def test_pair_queries_shuffle_once(spark):
    rng = random.Random(6)
    rows = [("test", q, i, rng.choice([rng.random(), 0.5]), rng.random(), rng.random() < 0.4) for q in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "query_split string, query_idx long, position int, score double, target double, correct boolean")
    p = [(a, b) for a, b in combinations(rows, 2) if a[1] == b[1] and abs(a[4] - b[4]) > 0.02]
    assert {(r.query_idx, r.i, r.j, r.ds, r.dt) for r in pairs.preference_pairs(df).collect()} == {(a[1], a[2], b[2], a[3] - b[3], a[4] - b[4]) for a, b in p}
    soft = lambda x: math.log1p(math.exp(x))
    r = pairs.pairwise_loss(df, temperature=0.7).first()
    assert r.pairs == len(p) and r.loss == pytest.approx(sum(soft(-sign(a[4] - b[4]) * (a[3] - b[3]) / 0.7) for a, b in p) / len(p))
    r = pairs.pairwise_accuracy(df).first()
    assert r.pairs == len(p) and r.accuracy == pytest.approx(sum(sign(a[4] - b[4]) == sign(a[3] - b[3]) for a, b in p) / len(p))
    e = {(x[1], x[2]): math.exp(x[4] / 0.5) for x in rows}
    w = lambda x: e[x[1], x[2]] / sum(v for k, v in e.items() if k[0] == x[1])
    weight = [w(a) + w(b) for a, b in p]
    want = sum(v * soft(-sign(a[4] - b[4]) * (a[3] - b[3])) for v, (a, b) in zip(weight, p)) / sum(weight)
    assert pairs.weighted_pairwise_loss(df, 0.5).first().loss == pytest.approx(want)
    per = [[soft(-(a[3] - b[3])) for a in rows for b in rows if a[1] == b[1] == q and a[5] and not b[5]] for q in range(6)]
    r = pairs.crossing_loss(df).first()
    assert r.queries == sum(map(bool, per)) and r.loss == pytest.approx(sum(sum(v) / len(v) for v in per if v) / r.queries)
    spread = df.repartition(3)
    for f in (pairs.pairwise_loss, pairs.pairwise_accuracy, pairs.crossing_loss):
        plan = f(spread)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("hashpartitioning(query_split") == 1
    none = df.filter("query_idx < 0")
    assert pairs.pairwise_loss(none).first().asDict() == {"pairs": 0, "loss": 0.0} and pairs.pairwise_accuracy(none).first().accuracy is None
    assert pairs.preference_pairs(none).count() == 0 and pairs.crossing_loss(none).first().loss == 0.0
