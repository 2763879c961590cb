"""What a large search shuffles and repeats doesn't grow with the clusters that are visited."""

import random

import pytest

from shortlist.operators import neighbours, retrieval

from .test_neighbours import SHOWN, same
from .test_retrieval import rows


def shuffled(spark, run):
    """Records that ``run`` writes to shuffles."""
    store, doubles = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        stages = store.stageList(None, False, False, doubles, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def gauss(spark, n, width=6, seed=2):
    rng = random.Random(seed)
    return rows(spark, [[rng.gauss(0, 1) for _ in range(width)] for _ in range(n)], "train", [i % 5 for i in range(n)])


def test_rows_are_shuffled_once_for_each_slice_and_chunk(spark):
    """Random vectors let no cluster be skipped; each query once went to each of the 40 and brought m rows from there."""
    g = gauss(spark, 400)
    found = retrieval.top_m(g, g, 5, clusters=40)
    assert shuffled(spark, lambda: found.write.format("noop").mode("overwrite").save()) < 4 * 400


def test_slices_are_merged(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE_BYTES", 8 * 6 * 50, raising=False)
    g = gauss(spark, 300)
    same(retrieval.top_m(g, g, 7, clusters=6), retrieval.top_m(g, g, 7, clusters=0), SHOWN[:-1])


def test_equal_vectors_tie_wherever_they_are(spark):
    """Sums of products differ in their last bits from place to place in a matrix product; the lower id still comes first."""
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(61)] for _ in range(40)]
    g, q = rows(spark, [vectors[i % 40] for i in range(523)], "train"), rows(spark, vectors[:9], "test")
    got = {}
    for r in retrieval.top_m(q, g, 30, clusters=3).orderBy("query_idx", "position").collect():
        got.setdefault((r.query_idx, r.example_idx % 40), []).append(r.example_idx)
    assert all(ids == sorted(ids) and ids[0] == ids[0] % 40 for ids in got.values())


@pytest.mark.parametrize("pool_size", [1, 4])
def test_controls_search_once(spark, pool_size):
    g = gauss(spark, 200)
    sets = spark.createDataFrame([("train", i, k, list(range(k))) for i in range(200) for k in (2, 3)], "query_split string, query_idx long, k int, classes array<int>")
    every = retrieval.controls(g, g, sets, 9, pool_size)
    want = retrieval.restricted(g, g, sets, pool_size).filter("position = 0").selectExpr("query_idx", "k", "example_idx AS restricted_top1")
    same(every, want, ["query_idx", "k", "restricted_top1"])
    facts = retrieval.pool_facts(retrieval.restricted(g, g, sets, pool_size), ["query_split", "query_idx", "k"])
    same(retrieval.with_facts(g, g, sets, 9, pool_size), facts, ["query_split", "query_idx", "k", "pool_size", "has_true", "top1_same_class"])
