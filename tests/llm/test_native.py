"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shortlist.llm import op01_sharding as op1
from shortlist.llm import op04_mixing as op4

from .helpers import clashing, corpus, docs, write


def check_shards(out, rows):
    assert Counter((r.doc_id, r.text_crc32) for r in out) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_query(spark, tmp_path):
    rows = corpus(n=300)
    out = op1.op1_sharding(spark, write(spark, tmp_path, documents=docs(spark, rows).repartition(5))).collect()
    check_shards(out, rows)
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    size = {r.doc_id: r.size for r in out}
    assert size[310] == 1 and size[311] == 1 and size[314] == len("zähl Ünïcode 漢字 🙂 words".encode()) + 1


def test_shuffle_is_seeded_whole_and_carries_columns(spark):
    d = clashing(docs(spark, corpus(n=200))).drop("shard", "slot")
    a, b = (op1.shard(x, bucket_rows=16).collect() for x in (d, d.repartition(7)))
    assert sorted(map(str, a)) == sorted(map(str, b))
    c = op1.shard(d, bucket_rows=16, seed=5).collect()
    assert sorted(map(str, a)) != sorted(map(str, c)) and Counter(r.doc_id for r in a) == Counter(r.doc_id for r in c)
    assert op1.shard(d.limit(0)).count() == 0
    assert op1.shard(clashing(docs(spark))).count() == len(corpus())


def test_one_key_with_most_rows(spark):
    rows = [(1, "same", "en", "s", 4)] * 600 + [(i, f"t{i}", "en", "s", 2) for i in range(100)] + [(None, f"u{i % 90}", None, "s", 2) for i in range(300)]
    d = docs(spark, rows)
    a, b = (op1.shard(x, bucket_rows=16).collect() for x in (d.repartition(2), d.repartition(9)))
    slots = Counter(r.shard for r in a)
    assert len(a) == 1000 and max(slots.values()) - min(slots.values()) <= 1 and len({(r.shard, r.slot) for r in a}) == 1000
    assert sorted(map(str, a)) == sorted(map(str, b))  # whatever the partitions, also where most rows are one
    assert Counter((r.doc_id, r.text, r.lang) for r in a) == Counter((r[0], r[1], r[2]) for r in rows)


def test_equal_rows_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(op1, "RUN", 7)
    monkeypatch.setattr(op1, "BUCKETS_A_GROUP", 3)
    a = op1.shard(docs(spark, [(1, "same", "en", "s", 4)] * 200 + [(2, None, None, None, None)] * 50), bucket_rows=16).collect()
    assert Counter(r.doc_id for r in a) == {1: 200, 2: 50} and len({(r.shard, r.slot) for r in a}) == 250 and max(r.slot for r in a) == 31


def test_written_shards(spark, tmp_path):
    out = op1.write_shards(docs(spark), str(tmp_path / "out"), bucket_rows=4)
    assert out.count() == spark.read.parquet(str(tmp_path / "out")).count() == len(corpus())
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):  # every file holds its rows in order
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)
    assert op1.write_shards(docs(spark, []), str(tmp_path / "none")).count() == 0


def filled(sizes):
    """Targets by repeated resharing."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be"))))}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        left = budget - sum(target.values())
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def check_mix(out, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = filled(sizes)
    source = {r[0]: r[3] for r in rows}
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= biggest[s] + 1e-6 for s in want)
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)


def test_mixing_query(spark, tmp_path):
    rows = corpus(n=400)
    d = docs(spark, rows)
    first = op4.op4_mixing(spark, write(spark, tmp_path / "a", documents=d.repartition(3))).collect()
    again = op4.op4_mixing(spark, write(spark, tmp_path / "b", documents=d.repartition(5))).collect()
    check_mix(first, rows)
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mixing_with_one_hot_item_and_tiny_sources(spark, tmp_path):
    rows = [(1, "a b c", "en", "hot", 5)] * 501 + [(i, "x y " * (i % 7), "en", f"s{i % 11}", 0) for i in range(2, 300)]
    check_mix(op4.op4_mixing(spark, write(spark, tmp_path, documents=docs(spark, rows))).collect(), rows)


def test_rounding_is_unbiased(spark):
    rows = [(i, "w " * (1 + i % 5), "en", f"s{i % 2}", 0) for i in range(60)]
    total, target = Counter(), {}
    for seed in range(12):
        for r in op4.decide(docs(spark, rows), seed).collect():
            total[r.doc_id] += r.copies
            target[r.doc_id] = r.target / r.source_size
    off = [total[i] / 12 - target[i] for i in total]
    assert abs(sum(off) / len(off)) < 0.05 and max(map(abs, off)) < 0.6


def test_mixed_documents(spark):
    d = clashing(docs(spark))
    out = op4.mix_documents(d)
    assert out.columns == d.columns
    mix = {(r.doc_id, r.source, r.size): r for r in op4.decide(d).collect()}
    got = Counter(r.doc_id for r in out.collect())
    assert got == +Counter({k[0]: r.copies for k, r in mix.items()})
    assert op4.mix_documents(d.limit(0)).count() == 0 and op4.decide(d.filter("text IS NULL")).count() == 1
