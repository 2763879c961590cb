"""Importance resampling, conversation repair, SimHash: against SQL, brute force and a plain library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shortlist.llm import op11_resampling as op11
from shortlist.llm import op12_conversations as op12
from shortlist.llm import op13_simhash as op13

from .helpers import clashing, corpus, docs, words, write


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- 11 -------------------------------------------------------------------------------------------------------------


def runs(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in runs(t)[1])
    s, t = count(r[1] for r in rows), count(target)
    ns, nt = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + 10000) / ((s[b] + 1.0) * (nt + 10000)))) for b in s}
    out = []
    for r in rows:
        n, f = runs(r[1])
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f)
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([n, r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((o for o in out if o[0] >= 20), key=lambda o: (-o[4], o[1] is None, o[1] or 0, o[2], o[3]))
    for i, o in enumerate(can[: 5 * len(can) // 100]):
        o[5] = i + 1
    return Counter(tuple(o[1:]) for o in out)


LONG_WORDS = " ".join(["x" * 63, "y" * 64, "z" * 65, "é" * 200, "Q" * 1000] * 5)


def test_resampling_equals_brute_force(spark):
    rows = corpus() + [(900, LONG_WORDS, "en", "s", 0), (901, "A b A b " * 3000, "en", "s", 0), (902, "Zähl " * 25, "de", "s", 0)]
    target = [rows[3][1], rows[5][1], None, "", LONG_WORDS]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(target)], "item_id string, text string")
    got = op11.resample(clashing(docs(spark, rows)).repartition(3), t)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == resampled(rows, target)
    assert sum(n for r, n in resampled(rows, target).items() if r[4]) == 1


def test_resampling_without_rows_or_target(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert op11.resample(docs(spark, []), none).count() == 0
    rows = corpus()[:25]
    assert Counter(tuple(r) for r in op11.resample(docs(spark, rows), none).collect()) == resampled(rows, [])


def test_resampling_draws_the_target(spark):
    """Texts of the target's vocabulary are drawn; weights are integers whatever the number of planes."""
    rng = random.Random(3)
    one, two = words(rng, 50), ["q" + w for w in words(rng, 50)]
    rows = [(i, " ".join(rng.choices(two if i % 10 == 0 else one, k=60)), "en", "s", 0) for i in range(200)]
    target = spark.createDataFrame([("t", " ".join(rng.choices(two, k=5000)))], "item_id string, text string")
    drawn = op11.resample(docs(spark, rows), target).filter("rank IS NOT NULL").collect()
    assert len(drawn) == 10 and all(r.doc_id % 10 == 0 for r in drawn)
    counts = np.random.default_rng(1).integers(0, 70_000, (3, op11.BUCKETS))
    gain = np.random.default_rng(2).integers(-12_000, 12_000, op11.BUCKETS)
    assert op11.dot(counts, op11.gain_planes(gain)).tolist() == (counts @ gain).tolist()


def test_crc_of_parts():
    data = np.frombuffer(b"ab" * 3000, np.uint8)
    for n in (0, 1, 5, 64, 65, 1000, 5999):
        moved = op11._moved(np.array([zlib.crc32(b"head")], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(data[:n].tobytes()) == zlib.crc32(b"head" + data[:n].tobytes())


# -- 12 -------------------------------------------------------------------------------------------------------------


def talk(seed, n_conversations, most=12):
    """Conversations with odd roles, nulls, repeated rows, equal turns, unfinished and blank texts."""
    rng, rows = random.Random(seed), []
    for c in range(n_conversations):
        role = rng.choice(["user", "system", "assistant"])
        for t in range(rng.randint(1, most)):
            text = rng.choice(["One. ", "Two!", "Three?", "four", "", "  \n", None, "Five. more", "zähl.", "six" * 3 + "."]) if rng.random() < 0.5 else f"Text {rng.randint(0, 99)}."
            odd = rng.random()
            r = role if odd > 0.2 else rng.choice(["user", "assistant", "system", None, "", "tool", "usher", "User"])
            turn = rng.choice([t, t, t, t, t + 1, None, 0]) if rng.random() < 0.3 else t
            rows.append((c if c else None, turn, r, text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
            role = "user" if role != "user" else "assistant"
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def by_sql(tmp_path, spark, rows):
    path = tmp_path / "conversations.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(op12.OP12_SQL)
    names = [d[0] for d in found.description]
    return Counter(tuple(r[names.index(c)] for c in op12.NAMES_OUT) for r in found.fetchall())


def test_repair_equals_sql(spark, tmp_path):
    rows = talk(1, 400)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cost": F.lit(1), "key": F.lit("x"), "n": F.lit(2), "block": F.lit(3)}).repartition(3)
    want = by_sql(tmp_path, spark, rows)
    assert Counter(tuple(r) for r in op12.repair(op12.damage(df)).collect()) == want
    assert {"D", "I", "K", "R"} <= set("".join(r[7] for r in want))


def test_long_conversations_in_stretches(spark, tmp_path, monkeypatch):
    """Conversations cut into stretches of 7 turns: the same rows as from SQL, with repeats over stretches and all turns dropped or equal."""
    monkeypatch.setattr(op12, "BLOCK_ROWS", 7)
    rows = talk(2, 25, 60) + [(1000, None, "user", f"Same {i}.") for i in range(30)] + [(1001, i, "assistant", "Same.") for i in range(40)]
    rows += [(1002, i, "system", f"All {i}") for i in range(30)] + [(1003, 2**40, "user", "Far.")] * 20
    want = by_sql(tmp_path, spark, rows)
    got = op12.repair(op12.damage(spark.createDataFrame(rows, SCHEMA)), long_rows=9)
    assert Counter(tuple(r) for r in got.collect()) == want
    got = op12.repair(op12.damage(spark.createDataFrame(rows, SCHEMA)), long_bytes=40)
    assert Counter(tuple(r) for r in got.collect()) == want


def cheapest(codes):
    """Cost and audit by states, without targets or bands."""
    now = {0: (0, "")}
    for code in codes:
        kind, cut, new = code & 7, 3 * (code >= 8), {}
        for e, (cost, audit) in now.items():
            for m in range(3):
                due = 3 if e == 2 else 2
                ways = [(e, 4, "D"), (due, 3 + cut, "R")] + ([(kind, cut, "K")] if kind == due or (kind == 1 and e == 0 and not m) else [])
                for x, c, op in ways:
                    new[x] = min(new.get(x, (1 << 30, "")), (cost + 3 * m + c, audit + "I" * m + op))
                e = due
        now = new
    return min((c + 3 * len(op12.TAIL[x]), a + "I" * len(op12.TAIL[x])) for x, (c, a) in now.items())


@pytest.mark.parametrize("seed", range(4))
def test_alignment_equals_states(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.choice([1, 2, 3, 5, 8, 20, 60])
        kinds = rng.choice([[1, 2, 3, 0], [2, 3], [1], [2], [1, 2], [0, 3]])
        codes = bytes(rng.choice(kinds) + 8 * (rng.random() < rng.choice([0, 0.2, 0.9])) for _ in range(n))
        assert op12._whole(codes) == cheapest(codes)


def test_long_alignment_is_fast():
    rng = random.Random(5)
    codes = bytes((2 + i % 2 if rng.random() > 0.1 else rng.choice([0, 1, 2, 3])) + 8 * (rng.random() < 0.1) for i in range(2000))
    assert op12._whole(codes) == cheapest(codes)


def test_repair_of_nothing(spark):
    assert op12.repair(op12.damage(spark.createDataFrame([], SCHEMA))).count() == 0


# -- 13 -------------------------------------------------------------------------------------------------------------


def mark(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components_of(marks):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = np.array(sorted(root), np.uint64)
    for i, x in enumerate(u):
        for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ x) <= 2]:
            root[find(int(y))] = find(int(x))
    return {m: find(m) for m in marks}


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    base = words(rng, 400)
    rows = corpus() + [(500 + i, " ".join(base[: 300 + 10 * (i % 3)] + (["Odd"] if i % 2 else [])), "en", "s", 0) for i in range(12)]
    rows += [(600, "One two", "en", "s", 0), (601, "one  TWO", "en", "s", 0), (602, "x" * 100 + " " + "y" * 40, "en", "s", 0), (None, None, None, None, None)]
    got = op13.near_duplicates(clashing(docs(spark, rows)).repartition(4)).collect()
    own = [mark(r[1]) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r[0], f"{m:016x}") for r, m in zip(rows, own))
    of, least = components_of(own), defaultdict(list)
    for r, m in zip(rows, own):
        least[of[m]].append(r[0])
    ids = {c: min((d for d in v if d is not None), default=None) for c, v in least.items()}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r[0], ids[of[m]]) for r, m in zip(rows, own))
    assert op13.near_duplicates(docs(spark, [])).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("small", [2, 5, 64])
def test_links_of_dense_families(spark, small):
    """Families around one fingerprint, in chains and in one half: the same components however early groups are refined."""
    rng = random.Random(small)
    marks = {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 1 << 63}
    for bits in (range(64), range(32), range(32, 64), range(16), range(60, 64)):
        centre = rng.getrandbits(64)
        for _ in range(150):
            m = centre
            for b in rng.sample(list(bits), rng.randint(0, 4)):
                m ^= 1 << b
            marks.add(m)
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        marks.add(chain)
    found = op13.links(spark.createDataFrame([(signed(m),) for m in marks], "fp long"), small).collect()
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in pairs)
    want, root = components_of(marks), {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    group = lambda f: sorted(sorted(v) for v in _groups({m: f(m) for m in marks}).values())
    assert group(find) == group(want.get)


def _groups(of):
    out = defaultdict(list)
    for k, v in of.items():
        out[v].append(k)
    return out


def test_xxh64_of_all_lengths():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    ends = np.array([*range(0, 130), 1000, 4999, 5000])
    starts = np.array([max(0, e - n) for e, n in zip(ends, [*range(0, 130), 999, 4000, 5000])])
    assert op13.xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends)]


def test_queries_read_tables(spark, tmp_path):
    t = spark.createDataFrame([("a", "some item text")], "item_id string, text string")
    sf = write(spark, tmp_path, documents=docs(spark), benchmark=t, conversations=spark.createDataFrame(talk(4, 20), SCHEMA))
    assert op11.op11_resampling(spark, sf).count() == len(corpus()) == op13.op13_simhash(spark, sf).count()
    assert op12.op12_conversations(spark, sf).count() == 20
