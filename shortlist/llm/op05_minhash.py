"""Near-duplicate classes by Order MinHash.

Every text is a sequence of ``K``-word shingles, labelled by their occurrence (the second "a b c d e" differs from the
first).  For each of ``SKETCHES`` hash functions the ``L`` smallest shingles, in text order, form a bucket key; texts
that share a key are candidates.  A pair is linked if its edit similarity is ``SIMILARITY`` or more: a banded alignment of the
two texts finds W words in common order, and W / max(words_a, words_b) is that similarity.  Bands widen up to the one that
follows from the bound, so the alignment is exact.  (The same ratio without order bounds it from above and is tried first.)  As a
changed word spoils K shingles, a link also needs ``SHARED`` of the longer text's shingles to be in both, in any order; pairs
below that, whose edits are spread evenly, rarely share a bucket.  Every pair with 0.8 of the longer text's shingles in common
order has 0.8 of its words too, so all pairs of five-word shingles at 0.8 are among the links.  Classes are the connected components.

Scale: equal texts are one node (combined before the shuffle); a sketch row has ``SKETCHES`` longs.  In a bucket all nodes are
compared with one of them (a star) and components are formed.  Buckets whose nodes aren't in one component by then are taken
up again: nodes that share less than ``SHARED`` of their shingles with all the others there are out, exactly; the rest forms families of nodes with
common buckets, and each family is cut into blocks of a bounded size that are compared with each other (only pairs in different
components, until they are connected).  So no link is left out that would change a class, and groups whose members are
close to one of them cost about one comparison a member; a family without such a centre costs the square of its blocks.
Texts travel once a node and map task, then only for nodes in candidate pairs, to be joined with their pairs.
Two texts with a Jaccard similarity J of their shingles share no bucket with probability (1 - J ** L) ** SKETCHES: 5e-8 at
0.8, 2e-4 at two thirds (0.8 of the shingles of texts of one length), 0.04 at a half, 0.4 at a third (the bound ``SHARED``).

Nulls and odd input: a null text is a class of its own row; texts without words (empty too) are linked to equal texts only;
texts of fewer than K words are one shingle; a class's id is its smallest doc_id (null if it has none); repeated rows have
one class and one of them is kept; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

K = 5
L = 3
SKETCHES = 24
SIMILARITY = 0.8
#: Part of the longer text's shingles that linked texts have in common.
SHARED = 0.5
#: Half the width of the first band that an alignment tries; the next ones are four times as wide.
FIRST_BAND = 32
#: Shingles of a family's nodes that one block holds.
BLOCK_SHINGLES = 50_000


def _shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all rows in text order, and each row's range in them."""
    sizes = np.diff(rows)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    ranges = np.r_[0, np.cumsum(counts)]
    row = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(ranges[-1]) - ranges[row] + rows[row]
    out = np.full(len(row), np.uint64(k))
    for j in range(k):
        here = start + j < rows[row + 1]
        nxt = words[np.minimum(start + j, len(words) - 1)] if len(words) else out
        out = np.where(here, C.mix(out * np.uint64(0x9E3779B97F4A7C15) + nxt), out)
    order = np.lexsort((np.arange(len(out)), out, row))
    new = np.r_[True, (np.diff(row[order]) != 0) | (out[order][1:] != out[order][:-1])][: len(out)]
    first = np.flatnonzero(new)
    number = np.arange(len(out)) - np.repeat(first, np.diff(np.r_[first, len(out)]))
    label = np.empty(len(out), np.int64)
    label[order] = number
    return C.mix(out + C.mix(label.astype(np.uint64))), ranges


def _sketch(hashes: np.ndarray, ranges: np.ndarray, n: int, length: int) -> np.ndarray:
    """n bucket keys for each (non-empty) row: of the ``length`` smallest shingles, in text order."""
    sizes = np.diff(ranges)
    full = np.flatnonzero(sizes > 0)
    out = np.zeros((len(sizes), n), np.uint64)
    if not len(full):
        return out
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    need = np.minimum(sizes, length)
    # About 16 shingles of a row pass this bound; rows where too few do are looked at whole.
    bound = np.where(sizes > 16, 2.0**64 * 16 / np.maximum(sizes, 17), 2.0**64 * 0.9999).astype(np.uint64)[row_of]
    small = (sizes <= 16)[row_of]
    for i in range(n):
        h = C.mix(hashes ^ C.mix(np.array([i + 1], np.uint64))[0])
        low = (h <= bound) | small
        short = np.bincount(row_of[low], minlength=len(sizes)) < need
        at = np.flatnonzero(low | short[row_of] if short.any() else low)
        at = at[np.lexsort((h[at], row_of[at]))]
        row = row_of[at]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        chosen = np.sort(at[rank < length])  # text order; rows stay in order
        start = np.r_[0, np.cumsum(need[full])[:-1]]
        key = np.full(len(full), np.uint64(i))
        for j in range(length):
            some = need[full] > j
            key[some] = C.mix(key[some] * np.uint64(0x9E3779B97F4A7C15) + hashes[chosen[start[some] + j]])
        out[full, i] = key
    return out


def sketches(docs: DataFrame, k: int = K, length: int = L, n: int = SKETCHES) -> DataFrame:
    """doc_id, node (md5 of the text; null for null), keys array<long> (empty if there are no words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                starts, ends, rows = C.words_of(data, offsets, C.NOT_SPACE)
                hashes, ranges = _shingles(C.word_hashes(data, starts, ends), rows, k)
                keys = _sketch(hashes, ranges, n, length)
                some = np.diff(ranges) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:end], batch.column("node")[first:end],
                     C.lists(keys[some].view(np.int64).ravel(), np.where(some, n, 0), pa.int64())],
                    ["doc_id", "node", "keys"],
                )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("node"), "text")
    return text.mapInArrow(sketch, "doc_id long, node binary, keys array<long>")


def _common_in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence, if at most ``band`` elements of both together are outside it."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    # Row i of the table holds columns i - band .. i + band; b is padded with values that match nothing.
    width = 2 * band + 1
    padded = np.zeros(len(b) + 2 * (band + 1) + len(a), np.uint64)
    valid = np.zeros(len(padded), bool)
    padded[band : band + len(b)] = b
    valid[band : band + len(b)] = True
    row = np.zeros(width, np.int32)
    for i in range(len(a)):
        match = (padded[i : i + width] == a[i]) & valid[i : i + width]
        straight = row + match
        above = np.r_[row[1:], 0]
        row = np.maximum.accumulate(np.maximum(straight, above))
    return head + tail + int(row.max())


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the words that the sequences a and b have in common order are ``least`` of the longer one's."""
    need = _need(len(a), len(b), least)
    if not len(a) or not len(b) or min(len(a), len(b)) < need:
        return False
    sets, number = np.unique(np.r_[a, b], return_inverse=True)
    if np.minimum(np.bincount(number[: len(a)], minlength=len(sets)), np.bincount(number[len(a) :], minlength=len(sets))).sum() < need:
        return False
    # What an alignment in a narrow band finds is a lower bound; in the last band it is exact.
    band, last = FIRST_BAND, len(a) + len(b) - 2 * need
    while band < last:
        if _common_in_order(a, b, band) >= need:
            return True
        band *= 4
    return _common_in_order(a, b, last) >= need


def linked(words: tuple[np.ndarray, np.ndarray], shingles: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> bool:
    """Whether two texts, given by their words and their labelled shingles, are linked."""
    a, b = shingles
    if not len(a) or not len(b) or len(np.intersect1d(a, b, assume_unique=True)) < _need(len(a), len(b), SHARED):
        return False
    return similar(*words, least)


def _need(n: int, m: int, least: float) -> int:
    """``least`` of the longer one of sequences of n and m elements, as a whole number."""
    return math.ceil(least * max(n, m) - 1e-9)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the ``nodes``, once each.  The only pass that shuffles all texts; by a merge join at any size.

    Copies are combined before the shuffle, so that a task meets a text once for each task before it, not once a copy.
    """
    own = docs.filter("text IS NOT NULL").groupBy(F.unhex(F.md5("text")).alias("node")).agg(F.first("text").alias("text"))
    return C.settle(own.join(nodes.hint("merge"), "node", "left_semi"), "texts")


def _verify(pairs: DataFrame, texts: DataFrame, least: float, k: int) -> DataFrame:
    """The linked ones among ``pairs`` (a, b)."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequences(column) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for _, _, data, offsets in C.utf8_blocks(column):
                starts, ends, rows = C.words_of(data, offsets, C.NOT_SPACE)
                words = C.word_hashes(data, starts, ends)
                hashes, ranges = _shingles(words, rows, k)
                out += [(words[rows[i] : rows[i + 1]], hashes[ranges[i] : ranges[i + 1]]) for i in range(len(rows) - 1)]
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                both_ = zip(sequences(batch.column("ta")), sequences(batch.column("tb")))
                ok = [linked((x[0], y[0]), (x[1], y[1]), least) for x, y in both_]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, c for the nodes of ``links`` (a, b with a <> b): c is the smallest node of the component.

    Every round gives a node the smallest of its neighbours and itself, then that one's own, and contracts the links to those: links
    inside of what has grown together are gone, equal ones are one.  So a later round has only what is left to connect.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = C.settle(ends.distinct(), "links")
    rounds = []
    while True:
        low = left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("c"))
        jump = low.join(low.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c").select("node", F.col("cc").alias("c"))
        rounds.append(C.settle(jump, "labels"))
        met = left.join(rounds[-1].select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(
            rounds[-1].select(F.col("node").alias("b"), F.col("c").alias("cb")), "b"
        )
        left = C.settle(met.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        if left.isEmpty():
            break
    labels = rounds[0]
    for later in rounds[1:]:
        labels = labels.join(later.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", F.coalesce("cc", "c").alias("c"))
    return C.settle(labels, "labels") if rounds[1:] else labels


def _families(buckets: DataFrame) -> DataFrame:
    """node, f for the ``buckets`` (key, node) of two nodes or more: nodes that share a bucket, directly or through others, have one f."""
    low = buckets.groupBy("key").agg(F.min("node").alias("a"))
    met = components(buckets.join(low, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    return met.withColumnRenamed("c", "f")


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a column of lists of longs."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False)


def _offer(table: pa.Table) -> pa.Table:
    """The different shingles of one block, dealt into as many slices as its family has blocks; ``again`` has those of several nodes."""
    values, times = np.unique(_values(table.column("hashes")), return_counts=True)
    blocks = table.column("blocks")[0].as_py()
    dealt = (values.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
    lists = []
    for some in (times == 1, times > 1):
        order = np.argsort(dealt[some], kind="stable")
        lists.append(C.lists(values[some][order], np.bincount(dealt[some], minlength=blocks), pa.int64()))
    f, block = table.column("f")[0].as_py(), table.column("block")[0].as_py()
    return pa.table({"f": pa.array([f] * blocks, pa.binary()), "slice": pa.array(np.arange(blocks, dtype=np.int32)),
                     "block": pa.array([block] * blocks, pa.int32()), "once": lists[0], "again": lists[1]})


def _meet(table: pa.Table) -> pa.Table:
    """Of one slice of a family's shingles: for each block those that are in several nodes."""
    parts = [(_values(table.column(name).slice(i, 1)), weight) for i in range(table.num_rows) for name, weight in (("once", 1), ("again", 2))]
    different, number = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    sizes = [len(x) for x, _ in parts]
    nodes = np.bincount(number, np.repeat([w for _, w in parts], sizes), minlength=len(different))
    cuts = np.r_[0, np.cumsum(sizes)][::2]
    shared = [different[own[nodes[own] > 1]] for own in (number[x:y] for x, y in zip(cuts[:-1], cuts[1:]))]
    lists = C.lists(np.concatenate(shared), np.array([len(x) for x in shared]), pa.int64())
    return pa.table({"f": table.column("f"), "block": table.column("block"), "shared": lists})


def _kept(nodes: pa.Table, slices: pa.Table) -> pa.Table:
    """node, n, seq, words of one block's nodes that share enough; ``slices`` has what the family's blocks share (none if it is one block)."""
    column = nodes.column("hashes")
    counts = pc.list_value_length(column).to_numpy().astype(np.int64)
    values, row = _values(column), np.repeat(np.arange(len(counts)), counts)
    different, number, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.isin(different, _values(slices.column("shared"))) if slices.num_rows else times > 1
    found = shared[number]
    sizes = np.bincount(row[found], minlength=len(counts))
    seq = C.lists(values[found], sizes, pa.int64())
    out = pa.table({"node": nodes.column("node"), "n": pa.array(counts.astype(np.int32)), "seq": seq, "words": nodes.column("words")})
    return out.filter(pa.array(sizes >= SHARED * counts))


def _shared_shingles(open_: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """node, n, seq, words for the nodes of ``open_`` (key, node) that can still have a partner there.

    seq holds the shingles that some other node of the family has too, words the hashes of all words.  A partner shares ``SHARED``
    of the n at least, so nodes with a smaller seq have none.  A family of several blocks exchanges each block's different shingles, in
    slices by their value: near copies in one block send a shingle once, and a slice meets a shingle once a block, however common it is.
    """
    texts = texts.join(_families(open_.select("key", "node")).hint("merge"), "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                starts, ends, rows = C.words_of(data, offsets, C.NOT_SPACE)
                words = C.word_hashes(data, starts, ends)
                hashes, ranges = _shingles(words, rows, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node")[first:end], batch.column("f")[first:end], C.lists(hashes.view(np.int64), np.diff(ranges), pa.int64()),
                     C.lists(words.view(np.int64), np.diff(rows), pa.int64())],
                    ["node", "f", "hashes", "words"],
                )

    whole = texts.select("node", "f", "text").mapInArrow(cut, "node binary, f binary, hashes array<long>, words array<long>")
    whole = C.settle(whole, "shingles")
    blocks = F.ceil(F.sum(F.size("hashes")) / BLOCK_SHINGLES).cast("int")
    sizes = C.settle(whole.groupBy("f").agg(blocks.alias("blocks")), "sizes")
    placed = whole.join(sizes, "f").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    several = placed.filter("blocks > 1").select("f", "blocks", "block", "hashes").groupBy("f", "block")
    offered = several.applyInArrow(_offer, "f binary, slice int, block int, once array<long>, again array<long>")
    shared = offered.groupBy("f", "slice").applyInArrow(_meet, "f binary, block int, shared array<long>")
    nodes = placed.select("f", "block", "node", "hashes", "words").groupBy("f", "block")
    kept = nodes.cogroup(shared.groupBy("f", "block")).applyInArrow(_kept, "node binary, n int, seq array<long>, words array<long>")
    return C.settle(kept, "survivors")


def _compare_blocks(table: pa.Table, least: float) -> pa.Table:
    """Links between the nodes of two blocks of a family (i, j: which), enough of them to connect what is connected."""
    nodes, classes_, n = table.column("node").to_pylist(), table.column("c").to_pylist(), table.column("n").to_numpy()
    block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column(name).combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        cuts = flat.offsets.to_numpy()
        return cuts - cuts[0], flat.flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    (cuts, values), (ends, words) = lists("seq"), lists("words")
    _, number = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(nodes)), np.diff(cuts))
    order = np.argsort(number, kind="stable")
    begin = np.searchsorted(number[order], np.arange((number.max() + 2) if len(number) else 1))
    holders = row[order]
    root = {c: c for c in classes_}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x in range(len(nodes)):
        own = number[cuts[x] : cuts[x + 1]]
        times = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        common = np.bincount(holders[at], minlength=len(nodes))
        near = common >= SHARED * np.maximum(n[x], n) - 1e-9
        near[: x + 1] = False
        if i != j:
            near &= block != block[x]
        for y in np.flatnonzero(near):
            a, b = find(classes_[x]), find(classes_[y])
            if a == b:
                continue
            if similar(words[ends[x] : ends[x + 1]], words[ends[y] : ends[y + 1]], least):
                out.append((nodes[x], nodes[y]))
                root[a] = b
    return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})


def _rest(open_: DataFrame, texts: DataFrame, least: float, k: int) -> DataFrame:
    """All links that matter among the nodes of unresolved buckets (key, node, c): families, in blocks against each other."""
    left = _shared_shingles(open_, texts, k)
    buckets = C.settle(open_.join(left.select("node"), "node", "left_semi"), "open")
    own = buckets.select("node", "c").distinct()
    rows = C.settle(left.join(own, "node").join(_families(buckets), "node"), "families")
    sizes = rows.groupBy("f").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.sum(F.size("seq")).alias("total")).filter("c0 <> c1")
    sizes = C.settle(sizes.select("f", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")), "sizes")
    placed = rows.join(sizes, "f").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("f", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c", "n", "seq", "words")
    return sent.groupBy("f", "i", "j").applyInArrow(lambda t: _compare_blocks(t, least), "a binary, b binary")


def classes(docs: DataFrame, least: float = SIMILARITY, k: int = K, length: int = L, n: int = SKETCHES) -> DataFrame:
    """doc_id, node, c, class_id for every row of ``docs`` (doc_id, text).

    c is the class itself (its smallest linked node, null for null texts); class_id, its smallest doc_id, can be equal or
    null for unrelated classes.
    """
    table = C.settle(sketches(docs, k, length, n), "sketches")
    nodes = C.settle(table.filter(F.size("keys") > 0).groupBy("node").agg(F.first("keys").alias("keys")), "nodes")
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    shared = C.settle(rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key"), "keys")
    members = C.settle(rows.join(shared, "key"), "members")
    # The centre of a bucket is its node with the most shared keys: the one that differs least from the others.
    ranked = members.join(members.groupBy("node").agg(F.count(F.lit(1)).alias("shared")), "node")
    centres = C.settle(ranked.groupBy("key").agg(F.max(F.struct("shared", "node")).alias("x")).select("key", F.col("x.node").alias("a")), "centres")
    stars = members.join(centres, "key").filter("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    texts = _texts(docs, members.select("node").distinct())
    links = C.settle(_verify(C.settle(stars.distinct(), "pairs"), texts, least, k), "found")
    labels = components(links)
    known = members.join(labels, "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
    many = C.settle(known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key"), "many")
    open_ = C.settle(known.join(many, "key"), "unresolved")
    met = labels.withColumnRenamed("node", "n")
    named = table.select("doc_id", "node").join(met, F.col("node") == F.col("n"), "left").select("doc_id", "node", F.coalesce("c", "node").alias("c"))
    if not open_.isEmpty():
        more = C.settle(_rest(open_, texts, least, k), "more")
        # Components met already are single nodes now: only links between them are left.
        own = open_.select("node", "c").distinct()
        between = more.join(own.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(
            own.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b"
        )
        merged = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b"))
        merged = merged.select(F.col("node").alias("old"), F.col("c").alias("new"))
        named = named.join(merged, F.col("c") == F.col("old"), "left").select("doc_id", "node", F.coalesce("new", "c").alias("c"))
    ids = C.settle(named.filter("c IS NOT NULL").groupBy(F.col("c").alias("k")).agg(F.min("doc_id").alias("class_id")), "ids")
    return named.join(ids, F.col("c") == F.col("k"), "left").select(
        "doc_id", "node", "c", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each class (smallest doc_id, then node); columns as in ``docs``.

    Rows with a null text stay.
    """
    docs, names = C.renamed(docs, "doc_id", "text")
    columns = docs.columns
    found = C.settle(classes(docs), "classes")
    first = found.filter(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("c").agg(
        F.first("doc_id").alias("doc_id"), F.min("node").alias("node"), F.count(F.lit(1)).alias("rows")
    ).select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), F.col("rows").alias("__rows"))
    keyed = docs.withColumn("__own", F.unhex(F.md5("text")))
    kept = keyed.join(first, keyed.doc_id.eqNullSafe(first["__id"]) & (F.col("__own") == F.col("__node")))
    once = kept.filter("__rows = 1").select(*columns)
    again = kept.filter("__rows > 1").dropDuplicates(["__own"]).select(*columns)
    return once.unionByName(again).unionByName(docs.filter("text IS NULL")).toDF(*names)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
