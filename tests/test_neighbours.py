"""Indexed search: equal to the search of all pairs, and with less work on clustered vectors."""

import random

import pytest
from pyspark.sql import functions as F

from shortlist.operators import neighbours, retrieval

from .test_retrieval import SCHEMA, rows, worlds

SHOWN = ["query_split", "query_idx", "true_class", "position", "example_idx", "class_idx", "similarity"]


def clustered(n, seed=1, centres=12, width=8, ids=0):
    """(split, id, class, vector) around a few centres, with equal vectors and whole-number parts so that ties are exact."""
    rng, out = random.Random(seed), []
    of = random.Random(99)
    middle = [[of.randint(-40, 40) for _ in range(width)] for _ in range(centres)]
    for i in range(n):
        c = rng.randrange(centres)
        out.append(("train", ids + i, rng.randrange(7), [float(x + rng.randint(-1, 1)) for x in middle[c]]))
    return out + [("train", ids + n + i, r[2], r[3]) for i, r in enumerate(out[: n // 10])]


def same(a, b, columns=SHOWN):
    a, b = a.select(*columns), b.select(*columns)
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("exclude_same_class,half", [(False, False), (True, False), (False, True)])
def test_indexed_search_equals_all_pairs(spark, monkeypatch, exclude_same_class, half):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8 * 8 * 20)  # blocks of 20 rows, so that clusters are cut
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 8 * 30)  # and chunks of 30 queries
    g = spark.createDataFrame(clustered(400), SCHEMA).repartition(3)
    q = g.filter("example_idx % 4 = 0").unionByName(spark.createDataFrame(clustered(60, 5), SCHEMA).withColumn("split", F.lit("test")))
    found, work = retrieval.searched(q, g, 9, exclude_same_class=exclude_same_class, half=half, clusters=12)
    same(found, retrieval.top_m(q, g, 9, exclude_same_class=exclude_same_class, half=half, clusters=0))
    done = work.agg(F.sum(F.col("queries") * F.col("gallery_rows"))).first()[0]
    assert done < q.count() * g.count() / 4


def test_indexed_search_of_class_sets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4 * 8 * 10)
    g, q, sets = worlds(spark, n=200)
    gd, qd = spark.createDataFrame(g, SCHEMA), spark.createDataFrame(q, SCHEMA)
    sd = spark.createDataFrame(sets + [("test", 0, 0, []), ("val", 1, 9, None), ("test", 3, 1, [13])], "query_split string, query_idx long, k int, classes array<int>")
    same(retrieval.top_m(qd, gd, 4, sets=sd, clusters=8), retrieval.top_m(qd, gd, 4, sets=sd, clusters=0), [*SHOWN, "k"])


def test_indexed_search_of_odd_galleries(spark):
    none, one = rows(spark, [], "train"), rows(spark, [[1, 0]] * 5, "train")
    q = rows(spark, [[1, 0], [0, 0], [-3, 1]], "test")
    assert retrieval.top_m(q, none, 3, clusters=4).count() == 0
    assert retrieval.top_m(none, one, 3, clusters=4).count() == 0
    same(retrieval.top_m(q, one, 3, clusters=4), retrieval.top_m(q, one, 3, clusters=0))
    same(retrieval.top_m(one, one, 9, clusters=4), retrieval.top_m(one, one, 9, clusters=0))
    wild = rows(spark, [[1e200, 1], [1e-200, 0], [5, 5]], "train")
    same(retrieval.top_m(q, wild, 2, clusters=2), retrieval.top_m(q, wild, 2, clusters=0))


def test_random_vectors_are_searched_whole(spark):
    """Where nothing can be skipped the result is the same."""
    rng = random.Random(4)
    g = rows(spark, [[rng.gauss(0, 1) for _ in range(16)] for _ in range(300)], "train")
    same(retrieval.top_m(g, g, 20, clusters=6), retrieval.top_m(g, g, 20, clusters=0), SHOWN[:-1])
