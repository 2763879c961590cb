"""Exact quantiles by ranges: against numpy, however few values a task may hold."""

import math
import random

import numpy as np
import pytest

from shortlist.operators import evaluate, quantiles

SHARES = [0.0, 0.05, 0.5, 0.95, 1.0]


def expected(values):
    v = np.sort(np.array([x for x in values if x is not None and not math.isnan(x)]))
    out = []
    for s in SHARES:
        p = s * (len(v) - 1)
        a, b = v[math.floor(p)], v[math.ceil(p)]
        out.append(a if a == b else a + (b - a) * (p - math.floor(p)))
    return out


def groups():
    rng = random.Random(1)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(1000)],
        "equal": [2.5] * 500,
        "magnitudes": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(800)],
        "extremes": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324] * 60,
        "outlier": [rng.random() for _ in range(900)] + [1e18],
        "one": [7.0],
        "infinite": [math.inf] * 40 + [-math.inf] * 10 + [rng.random() for _ in range(300)],
        "holes": [None, 1.0, math.nan, 2.0, None, 4.0],
        None: [float(i) for i in range(101)],
    }


@pytest.mark.parametrize("few", [3, 50, 100_000])
def test_quantiles_of_all_kinds_of_values(spark, few):
    want = groups()
    rows = [(g, x) for g, values in want.items() for x in values] + [("nothing", None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, x double").repartition(5)
    got = {r.name: r for r in quantiles.quantiles(df, ["name"], "x", SHARES, few).collect()}
    assert set(got) == set(want)
    for g, values in want.items():
        assert got[g].q == pytest.approx(expected(values), rel=1e-12, abs=0), g
        assert got[g].n == sum(x is not None and not math.isnan(x) for x in values)


def test_no_group_is_listed_whole(spark, monkeypatch):
    """With many more values than a task may hold, at most that many are sorted in one place."""
    df = spark.range(20_000).selectExpr("id % 2 AS g", "sqrt(id) AS x")
    seen = []
    read = quantiles._read
    monkeypatch.setattr(quantiles, "_read", lambda own, cells: seen.append([r.size for r in cells.collect()]) or read(own, cells))
    got = {r.g: r.q for r in quantiles.quantiles(df, ["g"], "x", SHARES, 100).collect()}
    assert max(n for c in seen for n in c) <= 100
    for g in (0, 1):
        assert got[g] == pytest.approx(expected([math.sqrt(i) for i in range(20_000) if i % 2 == g]))


def test_empty(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", [0.5]).count() == 0


def test_distribution_has_no_percentile(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(21)] + [("b", None)], "g string, x double")
    out = evaluate.distribution(df, "g", {"v": df.x, "w": -df.x})
    assert "percentile" not in out._jdf.queryExecution().toString()
    r = {(x.g, x.column): x for x in out.collect()}
    assert (r["a", "v"].p05, r["a", "v"].p50, r["a", "v"].p95, r["a", "w"].p05, r["a", "v"].mean) == (1.0, 10.0, 19.0, -19.0, 10.0)
    assert r["b", "v"].p50 is None and r["b", "v"].mean is None
