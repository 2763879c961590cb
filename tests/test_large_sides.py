"""Nothing made of class sets is broadcast, and quadratic intermediate rows aren't made."""

import random

import pyspark
import pytest
from pyspark.sql import functions as F

from shortlist.operators import labelsets, retrieval
from shortlist.plans import queries_retrieval, queries_scores

SETS = "query_split string, query_idx long, true_class int, k int, classes array<int>"


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 6) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trials_broadcast_no_options(spark, tables):
    w = queries_scores.World(spark, tables)
    found = plan(queries_scores._trials(w))
    assert "BroadcastHashJoin [query_split" not in found.split("sets-")[0][-4000:] and "Window" not in found
    joins = [x for x in found.splitlines() if "Join" in x]
    assert joins and "SortMergeJoin" in joins[0]  # the join of sets and conditions, the topmost


def test_letters_are_not_sorted_over_rows(spark):
    sets = spark.createDataFrame([("test", 0, 1, 3, [1, 2, 3]), ("val", 1, 2, 3, [2, 5, 7])], SETS)
    assert "Exchange" not in plan(labelsets.letters(sets, [1, 2]))
    with pytest.raises(pyspark.errors.PySparkException, match="more than 52"):
        labelsets.letters(spark.createDataFrame([("test", 0, 1, 53, list(range(53)))], SETS), [1]).collect()


def test_set_totals_equal_rows(spark, tables):
    sets = spark.createDataFrame([("test", 0, 1, 3, [1, 2, 3]), ("test", 0, 1, 2, [1, 9]), ("val", 1, 2, 3, [8, 9])], SETS)
    gallery = spark.createDataFrame([(i, i % 5) for i in range(40)], "example_idx long, class_idx int")
    want = labelsets.in_set(gallery, sets).groupBy("query_split", "query_idx", "k").agg(F.count(F.lit(1)).alias("n"), F.min("example_idx").alias("f"), F.sum("example_idx").alias("t"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, labelsets.in_set_totals(gallery, sets).collect()))
    # One row a pair of set and gallery row was joined before it was counted.
    found = plan(queries_retrieval.l5_in_set(spark, tables))
    assert "Broadcast" not in found and found.index("HashAggregate(keys=[class_idx") > found.index("SortMergeJoin")


def test_cosines_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "COSINE_ROWS", 3)
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [2.0]), (4, [1.0, None]), (5, [-3.0, 3.0]), (6, [])]
    e = spark.createDataFrame(rows, "example_idx long, vec array<float>")
    got = {(r.query_idx, r.example_idx): r.cosine for r in retrieval.cosines(e, e, 6).collect()}
    assert len(got) == 49 and got[0, 5] == got[5, 0] == -0.707107 and got[0, 0] == got[5, 5] == got[3, 3] == 1.0
    assert {k for k, v in got.items() if v is not None} == {(0, 0), (0, 5), (5, 0), (5, 5), (3, 3)}


def test_cosines_are_no_join_of_rows(spark, tables):
    assert "CartesianProduct" not in (found := plan(queries_retrieval.v2_cosine(spark, tables))) and "NestedLoop" not in found


def test_features_join_numbers_only(spark, tables):
    """Vectors of 4 numbers were joined to every candidate, thirty times a query; now at most once a query and class."""
    w = queries_scores.World(spark, tables)
    want = retrieval.scalar_features(retrieval.assemble(w.pool, w.queries, w.gallery, w.cv), 30)
    got = retrieval.pool_features(w.pool, w.queries, w.gallery, w.cv, 30)
    key = ["query_split", "query_idx", "position"]
    assert got.columns == want.columns and got.count() == want.count() == 120 * 30
    pairs = zip(got.orderBy(*key).collect(), want.orderBy(*key).collect())
    assert all(a[:4] == b[:4] and all(abs(x - y) < 1e-12 for x, y in zip(a[4:], b[4:])) for a, b in pairs)
    for name in ("v11_assemble", "v13_scalar_features"):
        pooled = [x for x in plan(getattr(queries_retrieval, name)(spark, tables)).splitlines() if "Exchange hashpartitioning(example_idx" in x or "Exchange hashpartitioning(query_split" in x]
        assert not any("vec" in x for x in pooled)


def test_losses_keep_numbers_only(spark, tables):
    w = queries_scores.World(spark, tables)
    assert not {"scores", "m", "z"} & set(w.ranked.columns)
    key = ["query_split", "query_idx", "position", "score", "correct", "margin", "target"]
    assert w.ranked.select(*key).exceptAll(w.cand.select(*key)).isEmpty() and w.ranked.count() == w.cand.count()


def test_one_search_for_the_first(spark, tables, monkeypatch):
    """Breakdown and prompts searched whole pools to use their first rows; the breakdown had searched for those already."""
    asked = []
    search = retrieval.top_m
    monkeypatch.setattr(retrieval, "top_m", lambda queries, gallery, m, *a, **b: asked.append(m) or search(queries, gallery, m, *a, **b))
    queries_scores.e7_copy_breakdown(spark, tables)
    assert asked == [1]
