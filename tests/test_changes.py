"""Changes: comparison by a tree of hashes, pools kept up with a changing gallery, samples by thresholds."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shortlist.operators import integrity, retrieval, sampling

from .test_neighbours import clustered
from .test_retrieval import SCHEMA

DATA = "id long, name string, v double"


def data(n, seed=1):
    rng = random.Random(seed)
    return [(i if i % 50 else None, rng.choice(["a", "b", None, ""]), rng.choice([1.0, None, rng.random()])) for i in range(n)]


@pytest.mark.parametrize("buckets,parts", [(4096, 64), (8, 2), (4, 4)])
def test_difference_with_multiplicity(spark, monkeypatch, buckets, parts):
    monkeypatch.setattr(integrity, "BUCKETS", buckets)
    monkeypatch.setattr(integrity, "PARTS", parts)
    rng = random.Random(buckets)
    a = data(400)
    b = [r for r in a if rng.random() > 0.02] + [(9999, "new", 0.5)] * 2 + a[:3] + [(7, None, None), (7, "", None)]
    rng.shuffle(b)
    got = Counter(tuple(r) for r in integrity.difference(spark.createDataFrame(a, DATA), spark.createDataFrame(b, DATA).select("v", "id", "name")).collect())
    ca, cb = Counter(a), Counter(b)
    assert got == Counter({(*r, "stored"): n for r, n in (ca - cb).items()}) + Counter({(*r, "rebuilt"): n for r, n in (cb - ca).items()})


def test_equal_tables_move_no_row(spark, tmp_path):
    a = spark.createDataFrame(data(500), DATA)
    a.write.parquet(str(tmp_path / "a"))
    b = spark.read.parquet(str(tmp_path / "a")).repartition(7)
    for out in (integrity.difference(a, b), integrity.misaligned(a.dropna(), b.dropna(), ["id"], "v", 0.1)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 0 and "Relation" in plan and "Scan" not in plan and "parquet" not in plan
    swapped = a.withColumn("v", F.when(F.col("id") == 3, 2.0).when(F.col("id") == 4, None).otherwise(F.col("v")))
    left, _ = integrity.where_unequal(a, swapped, ["id"], ["v"])
    assert 0 < left.count() < 30  # two buckets of the finest level, not the table
    pairs = spark.createDataFrame([(1,), (1,), (2,), (2,)], "id long")
    assert integrity.difference(pairs, pairs.replace(1, 3)).count() == 4  # sums don't cancel equal pairs


def test_misaligned_values(spark):
    a = [(i, float(i)) for i in range(200)]
    b = [(i, i + (0.05 if i % 3 else 0.0) + (1 if i == 77 else 0)) for i in range(1, 201)]
    frames = (spark.createDataFrame(x, "id long, v double") for x in (a, b))
    got = {r.id: (r.a, r.b and round(r.b, 6)) for r in integrity.misaligned(*frames, ["id"], "v", 0.1).collect()}
    assert got == {0: (0.0, None), 77: (77.0, 78.05), 200: (None, 200.05)}


@pytest.mark.parametrize("same_class", [False, True])
def test_pools_follow_a_changing_gallery(spark, same_class):
    rng = random.Random(3)
    rows = {r[1]: r for r in clustered(150, 2, centres=5, width=4)}
    q = spark.createDataFrame([("train", *r[1:]) for r in list(rows.values())[::6]] + [("test", i, *r[2:]) for i, r in enumerate(clustered(20, 8, centres=5, width=4)[:20])], SCHEMA)
    options = {"exclude_same_class": same_class}
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    pool, fresh = retrieval.top_m(q, frame(list(rows.values())), 6, **options), 1000
    shown = ["query_split", "query_idx", "true_class", "position", "example_idx", "class_idx", "similarity"]
    for _ in range(4):
        gone = rng.sample(sorted(rows), 5)
        vector = lambda: [float(x + rng.randint(-1, 1)) for x in rng.choice(list(rows.values()))[3]]
        added = [("train", i, rng.randrange(7), vector()) for i in [gone[0], *range(fresh, fresh + 6)]]  # one row changes
        fresh += 6
        rows = {i: r for i, r in rows.items() if i not in gone} | {r[1]: r for r in added}
        held = {(r.query_split, r.query_idx) for r in pool.filter(F.col("example_idx").isin(gone)).collect()}
        removed = spark.createDataFrame([(i,) for i in gone], "example_idx long")
        new, anew = retrieval.maintained(pool, q, frame(list(rows.values())), frame(added), removed, 6, **options)
        assert {tuple(r) for r in anew.collect()} == held and len(held) < q.count()
        found = [tuple(r) for r in new.select(*shown).collect()]
        assert Counter(found) == Counter(tuple(r) for r in retrieval.top_m(q, frame(list(rows.values())), 6, **options).select(*shown).collect())
        pool = spark.createDataFrame(found, new.select(*shown).schema)


def test_balanced_sample_without_an_order_of_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aaaaaaabbbccd") if i % 40 else rng.choice(["e", None, f"x{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string").repartition(5)
    size = Counter(c for _, c in rows)
    for n in (0, 1, 3, 7, 20, 61, 150, 399, 400, 999):
        got = sampling.balanced_sample(df, "id", "c", n, 5)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Limit" not in plan and "TakeOrdered" not in plan and "rangepartitioning" not in plan
        taken = [tuple(r) for r in got.collect()]
        assert len(taken) == min(n, 400) == len(set(taken)) and set(taken) <= set(rows)
        own = Counter(c for _, c in taken)
        most = max(own.values(), default=0)
        assert all(own[c] >= min(size[c], most - 1) for c in size)  # nobody lags by more than the round that isn't whole
    again = sorted(sampling.balanced_sample(df.repartition(2), "id", "c", 61, 5).collect())
    assert again == sorted(sampling.balanced_sample(df, "id", "c", 61, 5).collect())


def test_nth_smallest(spark):
    rng = random.Random(2)
    values = [f"{rng.choice(['aaaaaaa', 'aaab', 'c'])}{rng.getrandbits(64):016x}" for _ in range(300)] + ["f" * 20] * 5
    df = spark.createDataFrame([(v,) for v in values], "d string")
    for n in (1, 2, 150, 299, 301, 305):
        assert sampling.nth_smallest(df, "d", n, few=4) == sorted(values)[n - 1]
    assert sampling.nth_smallest(df, "d", 306) is None
