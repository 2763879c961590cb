"""Retrieval, class sets and sampling."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shortlist.operators import labelsets, retrieval, sampling

SCHEMA = "split string, example_idx long, class_idx int, vec array<double>"


def rows(spark, vectors, split, labels=None):
    return spark.createDataFrame([(split, i, (labels or [0] * len(vectors))[i], [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def test_pool_is_in_order(spark):
    p = retrieval.top_m(rows(spark, [[1, 0]], "test"), rows(spark, [[0.1, 0], [0.9, 0], [0.5, 0]], "train"), 2)
    assert [(r.example_idx, r.similarity) for r in p.orderBy("position").collect()] == [(1, 0.9), (2, 0.5)]


def test_restricted_pool(spark):
    g = rows(spark, [[1, 0], [0.8, 0.2], [0, 1]], "train", [0, 1, 2])
    q = rows(spark, [[1, 0]], "test")
    sets = spark.createDataFrame([("test", 0, 2, [1, 2]), ("test", 0, 1, []), ("test", 0, 3, None)], "query_split string, query_idx long, k int, classes array<int>")
    got = [(r.k, r.position, r.example_idx, r.similarity) for r in retrieval.restricted(q, g, sets, 2).orderBy("k", "position").collect()]
    assert got == [(2, 0, 1, 0.8), (2, 1, 2, 0.0), (3, 0, 0, 1.0), (3, 1, 1, 0.8)]  # an empty set gives an empty pool, null allows all


def worlds(spark, seed=6, n=90):
    """Queries of two splits with equal ids and a gallery with many equal vectors; class sets for both."""
    rng = random.Random(seed)
    vec = lambda: [float(rng.randint(-1, 1)) for _ in range(4)]
    g = [("train", i, rng.randrange(12), vec()) for i in range(n)]
    q = [(s, i, rng.randrange(12), vec()) for s in ("test", "val") for i in range(9)]
    sets = [(s, i, k, sorted(rng.sample(range(14), k))) for s, i, *_ in q for k in (2, 5)]
    return g, q, sets


def test_restricted_ranks_the_whole_gallery_for_colliding_ids(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SMALL_ROWS", 10)
    g, q, sets = worlds(spark)
    gd, qd = spark.createDataFrame(g, SCHEMA), spark.createDataFrame(q, SCHEMA)
    sd = spark.createDataFrame(sets, "query_split string, query_idx long, k int, classes array<int>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))

    def best(vec, allowed, m):
        found = sorted((-dot(vec, v), i, c) for _, i, c, v in g if allowed is None or c in allowed)
        return [(i, c) for _, i, c in found[:m]]

    vec = {(s, i): (v, c) for s, i, c, v in q}
    want = {(s, i, k, p, e) for s, i, k, classes in sets for p, (e, _) in enumerate(best(vec[s, i][0], classes, 3))}
    got = {(r.query_split, r.query_idx, r.k, r.position, r.example_idx) for r in retrieval.restricted(qd, gd, sd, 3).collect()}
    assert got == want
    out = retrieval.controls(qd, gd, sd, 7, 3).collect()
    assert len(out) == len(sets)
    for r in out:
        v, own = vec[r.query_split, r.query_idx]
        classes = next(c for s, i, k, c in sets if (s, i, k) == (r.query_split, r.query_idx, r.k))
        pool, first, same = best(v, classes, 3), best(v, None, 1)[0], best(v, [own], 1)
        assert r.restricted_top1 == (pool[0][0] if pool else None) and r.top1 == first[0] and r.top1_in_options == (first[1] in classes)
        assert r.same_class_top1 == (same[0][0] if same else None) and (r.random_member in [e for e, _ in pool] if pool else r.random_member is None)
    facts = {(r.query_split, r.query_idx, r.k): r for r in retrieval.pool_facts(retrieval.restricted(qd, gd, sd, 3), ["query_split", "query_idx", "k"]).collect()}
    for (s, i, k), r in facts.items():
        pool = best(vec[s, i][0], next(c for a, b, d, c in sets if (a, b, d) == (s, i, k)), 3)
        assert r.pool_size == len(pool) and r.has_true == any(c == vec[s, i][1] for _, c in pool) and r.top1_same_class == (pool[0][1] == vec[s, i][1])
    inside = {(r.query_split, r.query_idx, r.k, r.example_idx) for r in labelsets.in_set(gd, sd).collect()}
    assert inside == {(s, i, k, e) for s, i, k, c in sets for _, e, cls, _ in g if cls in c}
    classes = spark.createDataFrame([(c, [float(c)] * 4) for c in range(12)], "class_idx int, vec array<double>")
    a = retrieval.assemble(retrieval.top_m(qd, gd, 3), qd, gd, classes).collect()
    assert len(a) == 3 * len(q) and all(r.query_vec == vec[r.query_split, r.query_idx][0] and r.label_vec[0] == r.class_idx for r in a)


def test_letters_of_colliding_ids(spark):
    sets = spark.createDataFrame([("test", 0, 1, 3, [1, 2, 3]), ("val", 0, 2, 3, [2, 5, 7])], "query_split string, query_idx long, true_class int, k int, classes array<int>")
    out = {r.query_split: r for r in labelsets.option_map(labelsets.letters(sets, [42])).collect()}
    assert sorted(out["test"].options.values()) == [1, 2, 3] and sorted(out["val"].options.values()) == [2, 5, 7]
    assert all(set(r.options) == set("ABC") for r in out.values()) and out["val"].options[out["val"].true_letter] == 2


def test_block_search_equals_builtin_with_ties_and_self_exclusion(spark):
    rng = random.Random(1)
    g = rows(spark, [[rng.randint(-1, 1) for _ in range(4)] for _ in range(60)], "train", [i % 5 for i in range(60)])
    keys = ["query_idx", "position", "example_idx", "class_idx", "similarity"]
    a = retrieval.top_m(g, g.repartition(3), 7).select(*keys)
    b = retrieval.top_m_builtin(g, g, 7).select(*keys)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 420
    assert a.filter("query_idx = example_idx").count() == 0
    c = retrieval.top_m(g, g, 7, exclude_same_class=True)
    assert c.filter("class_idx = true_class").count() == 0


def test_half_precision_order_differs(spark):
    rng = random.Random(3)
    vec = lambda: [rng.gauss(3, 1) for _ in range(48)]
    g, q = rows(spark, [vec() for _ in range(130)], "train"), rows(spark, [vec() for _ in range(7)], "test")
    order = lambda half: [(r.query_idx, r.example_idx) for r in retrieval.top_m(q, g, 20, half=half).orderBy("query_idx", "position").collect()]
    assert order(True) == order(True) and len(order(True)) == 140
    assert order(True) != order(False)


def test_empty_inputs(spark):
    none = rows(spark, [], "test")
    assert retrieval.top_m(none, rows(spark, [[1, 0]], "train"), 3).count() == 0
    assert retrieval.top_m(rows(spark, [[1, 0]], "test"), none, 3).count() == 0


def test_prefix_and_nesting(spark):
    p = retrieval.top_m(rows(spark, [[1, 0]], "test"), rows(spark, [[0.1, 0], [0.9, 0], [0.5, 0]], "train"), 3)
    assert [r.rank_fraction for r in retrieval.pool_prefix(p, 3).orderBy("position").collect()] == [0, 0.5, 1]
    with pytest.raises(Exception, match="fewer"):
        retrieval.pool_prefix(p, 4).collect()
    back = retrieval.unnest(retrieval.nest(p))
    assert back.select("position", "example_idx").exceptAll(p.select("position", "example_idx")).count() == 0


def test_label_sets_are_nested(spark):
    eye = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "class_idx int, vec array<double>")
    q = spark.createDataFrame([("test", 0, 0, [0.1, 0.9, 0.8, 0.7])], SCHEMA)
    ranking = labelsets.class_ranking(labelsets.class_similarity(q, eye))
    sets = labelsets.label_sets(ranking, [2, 3, 4], 4)
    assert [r.classes for r in sets.orderBy("k").collect()] == [[0, 1], [0, 1, 2], [0, 1, 2, 3]]
    assert labelsets.nesting_violations(sets).count() == 0
    with pytest.raises(ValueError):
        labelsets.label_sets(ranking, [5], 4)
    clamped = labelsets.label_sets(ranking, [3, 9], 4, clamp=True)
    assert {r.k: r.classes for r in clamped.collect()} == {3: [0, 1, 2], 9: [0, 1, 2, 3]}
    letters = labelsets.letters(sets, [1, 2])
    options = labelsets.option_map(letters).collect()
    assert all(set(o.options) == set("ABCD"[: o.k]) and o.options[o.true_letter] == 0 for o in options)


def test_balanced_and_proportional_samples(spark):
    r = spark.createDataFrame([(i, i % 5) for i in range(20)], "id long, c long")
    got = sampling.balanced_sample(r, "id", "c", 8, 1).collect()
    n = Counter(x.c for x in got)
    assert len({x.id for x in got}) == 8 and max(n.values()) - min(n.values()) <= 1
    assert sorted(x.id for x in sampling.balanced_sample(r.repartition(7), "id", "c", 8, 1).collect()) == sorted(x.id for x in got)
    assert sampling.balanced_sample(r, "id", "c", 50, 1).count() == 20
    s = spark.createDataFrame([(i, int(i >= 8)) for i in range(10)], "id long, c int")
    assert Counter(x.c for x in sampling.proportional_sample(s, "id", "c", 5, 1).collect()) == {0: 4, 1: 1}
    assert Counter(x.c for x in sampling.learning_curve(s, "id", "c", 1, fraction=0.5).collect()) == {0: 4, 1: 1}
    with pytest.raises(ValueError):
        sampling.learning_curve(s, "id", "c", 1)


def test_splits(spark):
    r = spark.createDataFrame([(i, i % 3) for i in range(100)] + [(200, 9), (201, 9)], "id long, c long")
    out = sampling.stratified_split(r, "id", "c", 0.7, 0.15, 3)
    n = Counter((x.c, x.split) for x in out.collect())
    assert n[(0, "train")] == 24 and n[(9, "train")] == 1 and out.count() == 102
    index = sampling.dense_index(r, "id", "at")
    assert sorted(x["at"] for x in index.collect()) == list(range(102))
    classes = sampling.class_split(r, "c", 0.5, 0.25, 1)
    assert sorted(x.split for x in classes.collect()) == ["test", "train", "train", "val"]
    bad = sampling.verify_split(out.select("id", "split").filter("id > 0"), "id", r.select("id"))
    assert {x.kind: x.n for x in bad.collect()} == {"overlap": 0, "missing": 1, "unknown": 0}


def test_whole_queries_take_every_split(spark, tmp_path):
    from shortlist.plans import catalog

    rng = random.Random(11)
    e = [(i, i % 10, [rng.gauss(0, 1) for _ in range(6)]) for i in (*range(0, 60), *range(63, 90, 3))]
    spark.createDataFrame(e, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    ids = {i for i, *_ in e}
    assert {r.query_idx for r in run("m7_targets_whole").select("query_idx").distinct().collect()} == ids
    assert {r.query_split for r in run("p1_preference_pairs_whole").select("query_split").distinct().collect()} == {"train", "val", "test"}
    assert {r.query_split: r.queries for r in run("io4_teacher_artifact_whole").collect()} == {s: sum((i % 10 > 1) == (s == "train") for i in ids if i % 10) for s in ("train", "val")}
    assert Counter((r.query_idx, r.example_idx) for r in run("v2_cosine_whole").collect()) == Counter((i, j) for i in ids if i % 20 == 0 for j in ids)
    assert all(f"p{i}_" in " ".join(n for n in catalog.QUERIES if n.endswith("_whole")) for i in range(1, 12))


def test_split_file_has_many_parts(spark, tmp_path):
    from shortlist.sources import artifacts

    want = [(i, ("test", "val", *["train"] * 8)[i % 10]) for i in range(1000)]
    path = str(tmp_path / "splits")
    artifacts.write_split_parts(spark.createDataFrame(want, "global_idx long, split string").repartition(3), path, block=50)
    assert Counter(map(tuple, artifacts.read_split_parts(spark, path).collect())) == Counter(want)
    assert max(len(r.ids) for r in spark.read.json(path).collect()) < 100


def test_fingerprint_tree_is_of_ordered_blocks(spark):
    import hashlib

    from shortlist.operators import integrity

    def sha(values):
        return hashlib.sha256("\n".join(values).encode()).hexdigest()

    rows = [("a", i, f"v{i}") for i in range(97)] + [("b", i, f"w{i}") for i in range(5)]
    want = {}
    for g in "ab":
        level = [v for k, _, v in rows if k == g]
        for _ in range(3):
            level = [sha(level[i : i + 10]) for i in range(0, len(level), 10)]
        want[g] = level[0]
    df = spark.createDataFrame(rows, "g string, i long, v string")
    for parts in (1, 5):
        got = integrity.fingerprint_tree(df.repartition(parts), "g", "i", "v", block=10).collect()
        assert {r.g: r.fingerprint for r in got} == want and {r.g: r.n for r in got} == {"a": 97, "b": 5}


def test_large_fingerprint_doesnt_cancel_equal_pairs(spark):
    from shortlist.operators import integrity

    def of(rows, parts=1):
        df = spark.createDataFrame(rows, "g string, i long, v string").repartition(parts)
        return {r.g: (r.fingerprint, r.n) for r in integrity.fingerprint_large(df, "g", "i", "v").collect()}

    base = [("a", i, f"v{i}") for i in range(20)]
    assert of(base) == of(base[::-1], 4) and of(base)["a"][1] == 20
    swapped = [("a", i, f"v{ {3: 4, 4: 3}.get(i, i)}") for i in range(20)]
    twice = base + [("a", 3, "v3"), ("a", 3, "v3")]
    assert len({of(x)["a"] for x in (base, swapped, twice, base[:-1])}) == 4
