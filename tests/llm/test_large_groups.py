"""Large groups of near copies: what joins make grows with the nodes and links, not with rounds or with the shingles of all copies."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shortlist.llm import op05_minhash as op5

from .helpers import words
from .test_pairs import shingles


def joined(spark, first=0):
    """Rows out of all joins of the executions from number ``first`` on, and the next number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, rows, upto = store.executionsList(), 0, first
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        upto = max(upto, number + 1)
        if number < first:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for m in (metrics.apply(x) for x in range(metrics.size()) if "Join" in nodes.apply(j).name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows, upto


def test_components_join_what_is_left_to_connect(spark):
    rng = random.Random(4)
    names = [i.to_bytes(4, "big") for i in rng.sample(range(10**6), 900)]
    links = [(names[i], names[i + 1]) for i in range(399)]  # a path, in random order of names
    links += [(names[400 + i % 5], names[405 + i]) for i in range(490)]  # stars around five nodes
    links += [(names[400 + i % 4], names[405 + i]) for i in range(200)] + links[:7] + [(b, a) for a, b in links[:9]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for n in list(root)}
    table = spark.createDataFrame(links, "a binary, b binary")
    _, first = joined(spark)
    found = op5.components(table)
    rows, _ = joined(spark, first)
    got = [(bytes(r.node), bytes(r.c)) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert rows <= 12 * len(links)
    none = op5.components(table.limit(0))
    assert none.columns == ["node", "c"] and none.count() == 0


@pytest.mark.parametrize("block", [3_000, 1_000_000])
def test_shared_shingles_of_near_copies_without_a_row_each(spark, monkeypatch, block):
    monkeypatch.setattr(op5, "BLOCK_SHINGLES", block)
    rng = random.Random(6)
    base, texts = words(rng, 300), []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 60)):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["one two", "a a a a a a a a", " ".join(base[:150] + words(rng, 300)), " ".join(words(rng, 80))]
    nodes = [i.to_bytes(2, "big") for i in range(len(texts))]
    own = [set(shingles(t)) for t in texts]
    times = Counter(s for x in own for s in x)
    want = {n: (len(x), sum(times[s] > 1 for s in x)) for n, x in zip(nodes, own)}
    want = {n: x for n, x in want.items() if x[1] >= 0.5 * x[0]}
    assert 10 < len(want) < 85
    table = spark.createDataFrame(list(zip(nodes, texts)), "node binary, text string")
    # Buckets of sixty nodes, each with half of the next one's.
    open_ = spark.createDataFrame([(i // 30 + j, n, n) for i, n in enumerate(nodes) for j in range(2)], "key long, node binary, c binary")
    open_ = open_.join(open_.groupBy("key").count().filter("count > 1").select("key"), "key").select("key", "node", "c").localCheckpoint()
    _, first = joined(spark)
    found = op5._shared_shingles(open_, table, 5)
    rows, _ = joined(spark, first)
    got = {bytes(r.node): (r.n, len(r.seq), len(r.words)) for r in found.select("node", "n", "seq", "words").collect()}
    assert {n: x[:2] for n, x in got.items()} == want
    assert all(x[2] == len(texts[int.from_bytes(n, "big")].split()) for n, x in got.items())
    held = {v for r in found.select(F.explode("seq").alias("v")).collect() for v in r}
    assert len(held) <= sum(t > 1 for t in times.values())
    assert rows <= 30 * len(nodes)
