"""Near duplicates, decontamination, substring dedup: against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from shortlist.llm import common as C
from shortlist.llm import op05_minhash as op5
from shortlist.llm import op09_decontamination as op9
from shortlist.llm import op10_substring_dedup as op10

from .helpers import clashing, corpus, docs, text, words, write


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def shingles(t):
    w, seen, out = (t or "").split(), Counter(), []
    for j in range(max(len(w) - 4, min(len(w), 1))):
        k = tuple(w[j : j + 5])
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def true_classes(rows):
    """Connected components of equal texts and of pairs with 0.8 of the longer one's words in common order and half of its shingles."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            half = s[i] and s[j] and len(set(s[i]) & set(s[j])) >= 0.5 * max(len(s[i]), len(s[j])) - 1e-9
            a, b = rows[i][1].split(), rows[j][1].split()
            if rows[i][1] == rows[j][1] or (half and lcs(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((rows[i][0], ids[find(i)]) for i in range(len(rows)))


def family(seed=5, n=60, size=100):
    """One text with up to six changed words in each copy: chains of links around the threshold."""
    rng = random.Random(seed)
    base = words(rng, size)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0 if i % 9 == 0 else 1, 6)):
            w[rng.randrange(size)] = f"x{rng.randrange(50)}"
        rows.append((1000 + i, " ".join(w), "en", "s", 0))
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus() + family()
    got = op5.classes(clashing(docs(spark, rows)).repartition(4)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == true_classes(rows)


def test_similarity_is_exact_at_its_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.permutation(200)[: rng.integers(1, 60)].astype(np.uint64)
        b = np.insert(np.delete(a, rng.integers(0, len(a), len(a) // 6)), 0, rng.integers(300, 400, rng.integers(0, 5)).astype(np.uint64))
        b = b[np.sort(np.unique(b, return_index=True)[1])]
        need = 0.8 * max(len(a), len(b)) - 1e-9
        assert op5.similar(a, b) == (len(b) > 0 and lcs(a.tolist(), b.tolist()) >= need)


def test_blocks_of_one_family(spark, monkeypatch):
    monkeypatch.setattr(op5, "BLOCK_SHINGLES", 500)
    rows = family(seed=8, n=80)
    assert Counter((r.doc_id, r.class_id) for r in op5.classes(docs(spark, rows)).collect()) == true_classes(rows)


def test_similarity_of_words_repeated_and_in_wide_bands():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a = rng.integers(0, 40, rng.integers(1, 260)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 1 + len(a) // 4)))
        b = np.r_[b[len(b) // 9 :], rng.integers(0, 40, rng.integers(0, 1 + len(a) // 6)).astype(np.uint64)]
        need = 0.8 * max(len(a), len(b)) - 1e-9
        assert op5.similar(a, b) == (len(b) > 0 and lcs(a.tolist(), b.tolist()) >= need)


def spread(seed, n=30):
    """Pairs with one to nine stretches of words changed: edit similarities from 0.8 to 1 at any share of common shingles."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng, rng.randint(60, 300))
        rows.append((2 * i, " ".join(w), "en", "s", 0))
        for _ in range(rng.randint(1, 9)):
            at, long = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 60))
            w[at : at + long] = [f"y{rng.randrange(50)}" for _ in range(rng.randint(0, 2 * long))]
        rows.append((2 * i + 1, " ".join(w), "en", "s", 0))
    return rows


def test_recall_by_edit_similarity_of_words(spark):
    rows = spread(9) + spread(10)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    near = set()
    for i in range(0, len(rows), 2):
        a, b = rows[i][1].split(), rows[i + 1][1].split()
        if lcs(a, b) >= 0.8 * max(len(a), len(b)):
            near.add(i)
    found = {r.doc_id: r.class_id for r in op5.classes(docs(spark, rows)).collect()}
    together = {i for i in range(0, len(rows), 2) if found[i] == found[i + 1]}
    assert len(near) > 40 and together <= near and len(together) >= 0.9 * len(near)
    assert len(set(found.values())) == len(rows) - len(together)


def test_order_matters(spark):
    rng = random.Random(2)
    parts = [" ".join(words(rng, 30)) for _ in range(8)]
    rows = [(1, " ".join(parts), "en", "s", 0), (2, " ".join(parts[::-1]), "en", "s", 0)]
    assert {r.class_id for r in op5.classes(docs(spark, rows)).collect()} == {1, 2}


def test_one_of_each_class_stays(spark):
    d = clashing(docs(spark, corpus() + family()))
    out = op5.keep_one(d)
    ids = [r.doc_id for r in out.collect()]
    want = {c for (i, c), _ in true_classes(corpus() + family()).items()}
    assert out.columns == d.columns and Counter(ids) == Counter(want)
    assert op5.keep_one(d.limit(0)).count() == 0


def test_unrelated_rows_with_one_id_stay(spark):
    rng = random.Random(7)
    texts = [" ".join(words(rng, 40)) for _ in range(6)]
    near = texts[0].rsplit(" ", 1)[0] + " changed"
    ids = [None, None, None, 9, 9, 9]
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts)]
    rows += [(None, near, "en", "s", 0), (9, texts[3], "en", "s", 0), (12, texts[4], "en", "s", 0), (None, texts[5], "en", "s", 0)]
    out = [(r.doc_id, r.text) for r in op5.keep_one(clashing(docs(spark, rows)).repartition(3)).collect()]
    first = min((texts[0], near), key=lambda t: hashlib.md5(t.encode()).digest())
    assert Counter(out) == Counter([(None, first), (None, texts[1]), (None, texts[2]), *[(9, t) for t in texts[3:]]])


def test_banded_alignment_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 2)) if len(a) > 3 else a
        b = np.insert(b, rng.integers(0, len(b) + 1), rng.integers(0, 12)).astype(np.uint64)
        assert op5._common_in_order(a, b, len(a) + len(b)) == lcs(a.tolist(), b.tolist())
        outside = len(a) + len(b) - 2 * lcs(a.tolist(), b.tolist())
        assert op5._common_in_order(a, b, outside) == lcs(a.tolist(), b.tolist())


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return WORD.findall((t or "").encode().lower()) if t else []


def brute_hits(rows, items):
    windows = defaultdict(set)
    for item, t in items:
        w = low(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(item)
    lengths = {len(w) for w in windows}
    out = Counter()
    for i, t, *_ in rows:
        w, hit, found = low(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out[(i, len(w), len(hit), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))] += 1
    return out


def planted(rng):
    items = [(i, text(rng, n)) for i, n in enumerate((25, 12, 10, 9, 3, 1, 40))] + [(7, None), (8, ""), (None, text(rng, 14)), (0, text(rng, 25))]
    rows = corpus(n=30)
    for k, (i, t) in enumerate(items[:6] + items[9:10]):
        w = t.split()
        rows.append((500 + k, text(rng, 20) + "  " + "; ".join(w[: 11 + k]).upper() + ". " + text(rng, 5), "en", "s0", 0))
        rows.append((600 + k, " ".join(w[:8]), "en", "s0", 0))
    rows.append((700, items[1][1] + " " + items[6][1] + " " + items[1][1], "en", "s0", 0))
    return rows, items


def test_decontamination_equals_brute_force(spark, tmp_path):
    rows, items = planted(random.Random(4))
    b = spark.createDataFrame(items, "item_id long, text string")
    out = op9.op9_decontamination(spark, write(spark, tmp_path, documents=docs(spark, rows), benchmark=b))
    want = brute_hits(rows, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in out.collect()) == want
    blocks = op9.decontaminate(docs(spark, rows), b, ["doc_id"], block_windows=20)
    assert Counter((r.doc_id, r["__n_hit"]) for r in blocks.collect()) == Counter({(k[0], k[2]): 0 for k in want}) + Counter((k[0], k[2]) for k in want.elements())
    d = clashing(docs(spark, rows))
    assert op9.clean(d, b).count() == sum(v for k, v in want.items() if not k[4]) and op9.clean(d, b).columns == d.columns
    assert op9.clean(d.limit(0), b).count() == 0 and op9.clean(d, b.limit(0)).count() == len(rows)


def brute_repeats(rows, n=50):
    least, at = {}, []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at.append((i, w))
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    out = Counter()
    for i, w in at:
        gone = set()
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            if k in least and (i is None or least[k] < i):
                gone |= set(range(j, j + n))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    return out


def test_substring_dedup_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    passage = [words(rng, n) for n in (49, 50, 51, 75, 120)]
    rows = corpus(n=30)
    for k in range(20):
        p = passage[k % 5]
        cut = p[rng.randint(0, 8) :] if k > 9 else p
        rows.append((200 + (k * 7) % 20, " ".join(words(rng, rng.randint(0, 30)) + cut + words(rng, rng.randint(0, 70)) + (p if k % 4 == 0 else [])), "en", "s", 0))
    rows += [(300, " ".join(["a"] * 200), "en", "s", 0), (301, " ".join(["a"] * 120), "en", "s", 0), (302, " ".join(["a", "b"] * 60), "en", "s", 0)]
    rows += [(None, " ".join(passage[4]), "en", "s", 0), (400, " ".join(passage[4]), "en", "s", 0), (400, " ".join(passage[4]), "en", "s", 0), (400, "\t".join(passage[4]), "en", "s", 0)]
    out = op10.op10_substring_dedup(spark, write(spark, tmp_path, documents=clashing(docs(spark, rows)).repartition(3)))
    assert Counter(map(tuple, out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_repeats(rows)
    assert op10.remove_repeats(docs(spark, [])).count() == 0
    assert op10.levels(25, 50) == [25, 50] and op10.levels(13, 50) == [13, 26, 50] and op10.levels(60, 50) == [50]
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for shortest in (9, 50):  # four levels, and one
        again = op10.remove_repeats(docs(spark, rows), shortest=shortest)
        assert Counter(map(tuple, again.select(columns).collect())) == brute_repeats(rows)
    small = op10.remove_repeats(docs(spark, rows), window=7, shortest=2)
    assert Counter(map(tuple, small.select(columns).collect())) == brute_repeats(rows, 7)


def test_word_helpers_do_not_depend_on_the_block(monkeypatch):
    import pyarrow as pa

    texts = [r[1] for r in corpus()]

    def hashes():
        out = []
        for _, _, data, offsets in C.utf8_blocks(pa.array(texts)):
            s, e, rows = C.words_of(data, offsets, C.NOT_SPACE)
            h = C.word_hashes(data, s, e)
            out += [h[rows[i] : rows[i + 1]].tolist() for i in range(len(rows) - 1)]
        return out

    whole = hashes()
    monkeypatch.setattr(C, "BLOCK_BYTES", 500)
    assert hashes() == whole and [len(x) for x in whole] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
