"""SimHash near-duplicate components by deletion-variant signatures.

A text's fingerprint has bit i set if more than half of its shingles' hashes have.  Two fingerprints are linked if they differ
in at most ``DISTANCE`` (2) bits.  Cut into two segments instead of the usual three, one segment differs by at most one bit: so the
segment with one bit taken out (a wildcard, at each place in turn) is a key that both have.  Each fingerprint has 2 x 32 such
keys; fingerprints with a common key are compared, and the links' components are the classes.

Whole segments are keys too, so that under a wildcard key only fingerprints with different bits at its place need a
comparison, and their other segments then differ by one bit at most.

Groups of many fingerprints are refined by the same argument: the other segment is cut in two again, to 16 and then to 8 bits; where it may
differ by two bits in the same way, where by one the halves themselves are keys.  At the last level all but 9 bits are fixed,
so a group has 512 fingerprints at most, and a forest of its links is kept.  No limit is set on groups or partners, and no group of
more than ``SMALL`` members is compared as a whole before that level.

Scale: equal fingerprints are one row before anything else (combined map-side), so copies and the many texts without words
cost nothing here.  A fingerprint is shuffled 66 times as four longs; groups are runs of sorted rows, read as a stream, and
only links leave it.  Texts are read once and never shuffled.

Nulls and odd input: a null text has no words, as an empty one: its fingerprint is zero and is linked like any other; a
component's id is its smallest doc_id, null if it has none but null ones; repeated rows are in one component; long texts are read whole;
an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .op05_minhash import components

WORDS = 3
SEED = 42
DISTANCE = 2
#: Members of a group that are compared at once; larger groups are refined.
SMALL = 64
#: Bits of the segments of each level: two of them are cut from the bits that the level before left free.
WIDTHS = (32, 16, 8)

U64 = np.uint64
#: The primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of all slices of ``data``, step by step over slices that still have so many bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = (ends - starts).astype(np.int64)
    s = U64(seed)
    with np.errstate(over="ignore"):
        out = np.full(len(starts), s + P5)
        at = starts.copy()
        big = np.flatnonzero(size >= 32)
        if len(big):
            acc = [np.full(len(big), s + P1 + P2), np.full(len(big), s + P2), np.full(len(big), s), np.full(len(big), s - P1)]
            now, rounds = starts[big], size[big] // 32
            order = np.argsort(-rounds, kind="stable")
            for k in range(int(rounds.max())):
                some = order[: int(np.searchsorted(-rounds[order], -k, "left"))]
                for i in range(4):
                    acc[i][some] = _round(acc[i][some], lanes[now[some] + 32 * k + 8 * i])
            mixed = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for i in range(4):
                mixed = (mixed ^ _round(np.zeros(len(big), U64), acc[i])) * P1 + P4
            out[big] = mixed
            at[big] += 32 * rounds
        out += size.astype(U64)
        for _ in range(3):
            some = np.flatnonzero(ends - at >= 8)
            out[some] = _turn(out[some] ^ _round(U64(0), lanes[at[some]]), 27) * P1 + P4
            at[some] += 8
        some = np.flatnonzero(ends - at >= 4)
        out[some] = _turn(out[some] ^ (lanes[at[some]] & U64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at[some] += 4
        for _ in range(3):
            some = np.flatnonzero(ends - at >= 1)
            out[some] = _turn(out[some] ^ padded[at[some]].astype(U64) * P5, 11) * P1
            at[some] += 1
        out = (out ^ (out >> U64(33))) * P2
        out = (out ^ (out >> U64(29))) * P3
    return out ^ (out >> U64(32))


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes (``first``: where they begin, and the end) the bits that more than half of them have."""
    out = np.zeros(len(first) - 1, U64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > np.diff(first)[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The fingerprint of every text in ``data``."""
    lower = C.LOWER[data]
    starts, ends, rows = C.words_of(lower, offsets, C.NOT_SPACE)
    sizes, lengths = np.diff(rows), ends - starts
    # All words in one buffer, each followed by one space, so that a shingle is a slice of it.
    to = np.cumsum(lengths + 1) - 1
    joined = np.full(int(to[-1]) + 1 if len(to) else 0, 0x20, np.uint8)
    word = np.repeat(np.arange(len(starts)), lengths)
    source = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    joined[np.arange(len(word)) + word] = lower[source]
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    first = np.r_[0, np.cumsum(counts)]
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = np.arange(first[-1]) - first[row] + rows[row]
    last = np.minimum(begin + k, rows[row + 1]) - 1
    return _majority(xxh64(joined, (to - lengths)[begin], to[last]), first)


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, fp (a long with the fingerprint's bits) for every row of ``docs`` (doc_id, text)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                marks = text_fingerprints(data, offsets, k).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.array(marks)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, "doc_id long, fp long")


def _keys(width: int) -> Column:
    """The keys of one level, for rows (fp, far, side, free): two segments of ``width`` bits each are cut from ``free``.

    far = 2: for each segment the whole of it (the other one may differ by 2 bits) and, for each place, the segment without that bit (then
    the other one may differ by 1, and only fingerprints with different bits there, on different sides, are to be compared).
    far = 1: one of the segments is equal, sides stay as they are.  A struct of v (which key, and its bits), far, side, free.
    """
    mask = (1 << width) - 1

    def key(part: int, bits: Column, far: Column, side: Column, free: Column) -> Column:
        v = bits + F.lit(part << 32)
        return F.struct(v.alias("v"), far.cast("int").alias("far"), side.cast("int").alias("side"), free.alias("free"))

    two, one = [], []
    for segment in (0, 1):
        own = F.shiftright("free", width * segment).bitwiseAND(F.lit(mask))
        other = F.shiftright("free", width * (1 - segment)).bitwiseAND(F.lit(mask))
        whole = segment * (width + 1)
        two.append(key(whole, own, F.lit(2), F.lit(0), other))
        one.append(key(whole, own, F.lit(1), F.col("side"), other))
        for i in range(width):
            bit = F.shiftright(own, i).bitwiseAND(F.lit(1))
            two.append(key(whole + 1 + i, own.bitwiseAND(F.lit(mask ^ (1 << i))), F.lit(1), bit, other))
    return F.when(F.col("far") == 2, F.array(*two)).otherwise(F.array(*one))


def _linked(x: np.ndarray, y: np.ndarray, cross: np.ndarray, side_x: np.ndarray, side_y: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x ^ y) <= DISTANCE) & (~cross | (side_x != side_y))


def _pairs(fp: np.ndarray, cross: np.ndarray, side: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs with equal ``run`` numbers, for short runs."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(np.bincount(run).max(initial=0))):
        x = np.flatnonzero(run[:-d] == run[d:])
        x = x[_linked(fp[x], fp[x + d], cross[x], side[x], side[x + d])]
        a.append(x)
        b.append(x + d)
    return np.concatenate(a), np.concatenate(b)


def _forest(fp: np.ndarray, cross: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links of one group connect, one row of distances at a time."""
    a, b, free = [], [], np.ones(len(fp), bool)
    for root in range(len(fp)):
        queue = [root] if free[root] else []
        free[root] = False
        while queue:
            x = queue.pop()
            near = np.flatnonzero(free & _linked(fp, fp[x], cross, side, side[x])).tolist()
            free[near] = False
            a += [x] * len(near)
            b += near
            queue += near
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(rows: DataFrame, last: bool, small: int) -> DataFrame:
    """a, b, and null for links within groups of equal (g, v) of ``rows`` (g, v, fp, state); fp, state, g, v for members of groups of over ``small``.

    At the last level all groups are compared.  state holds free, side and far.  The rows come sorted; a group of at most
    ``small`` rows (at the last level: all that its 9 bits allow) is held, larger ones are passed on as they come.
    """

    def out(a, b, g=None, v=None) -> pa.RecordBatch:
        values = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b, g, v)]
        return pa.RecordBatch.from_arrays(values, ["a", "b", "g", "v"])

    def closed(g, v, fp, state, known_large: bool) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        sizes = np.diff(np.r_[first, len(g)])
        large = sizes > small
        large[0] |= known_large
        cross, side, marks = state & 1 == 0, state >> 1 & 1, fp.view(U64)
        if not last:
            passed = np.repeat(large, sizes)
            yield out(fp[passed], state[passed], g[passed], v[passed])
        else:
            for at, n in zip(first[large], sizes[large]):
                a, b = _forest(marks[at : at + n], cross[at : at + n], side[at : at + n])
                yield out(fp[at + a], fp[at + b])
        some = np.flatnonzero(np.repeat(~large & (sizes > 1), sizes))
        if len(some):
            run = np.cumsum(np.r_[False, (g[some][1:] != g[some][:-1]) | (v[some][1:] != v[some][:-1])])
            a, b = _pairs(marks[some], cross[some], side[some], run)
            yield out(fp[some[a]], fp[some[b]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known_large = [np.zeros(0, np.int64)] * 4, False
        for batch in batches:
            columns = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("g", "v", "fp", "state"))]
            g, v = columns[:2]
            if not len(g):
                continue
            open_ = int(np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])[-1])  # where the last group begins
            if open_:
                yield from closed(*[c[:open_] for c in columns], known_large)
                known_large = False
            rest = [c[open_:] for c in columns]
            if not last and (known_large or len(rest[0]) > small):
                yield from closed(*rest, True)
                rest, known_large = [c[-1:] for c in rest], True  # one row to know the group by; passed on again, it does no harm
            held = rest
        if len(held[0]):
            yield from closed(*held, known_large)

    dealt = rows.select("g", "v", "fp", "state").repartition("g", "v").sortWithinPartitions("g", "v")
    return C.settle(dealt.mapInArrow(walk, "a long, b long, g long, v long"), "compared")


def links(marks: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``marks`` (fp) that differ in at most two bits: all of them, or enough to connect the same."""
    found = None
    rows = marks.select("fp", F.lit(0).cast("long").alias("g"), F.lit(2).alias("far"), F.lit(0).alias("side"), F.col("fp").alias("free"))
    for width in WIDTHS:
        each = rows.select("fp", "g", F.explode(_keys(width)).alias("k"))
        state = F.shiftleft("k.free", 2) + F.shiftleft(F.col("k.side").cast("long"), 1) + (F.col("k.far") == 2).cast("long")
        out = _compare(each.select("g", "k.v", "fp", state.alias("state")), width == WIDTHS[-1], small)
        part = out.filter("g IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = part if found is None else found.unionByName(part)
        large = out.filter("g IS NOT NULL").select(F.col("a").alias("fp"), F.col("b").alias("state"), F.xxhash64("g", "v").alias("g")).distinct()
        large = C.settle(large, "large")
        if large.isEmpty():
            break
        side = F.shiftright("state", 1).bitwiseAND(F.lit(1)).cast("int")
        far = (F.col("state").bitwiseAND(F.lit(1)) + 1).cast("int")
        # Groups with one side only have nothing to compare.
        two = large.groupBy(F.col("g").alias("h")).agg(F.min(side).alias("s0"), F.max(side).alias("s1"), F.max(far).alias("f")).filter("f = 2 OR s0 < s1").select("h")
        rows = large.join(two, F.col("g") == F.col("h"), "left_semi").select("fp", "g", far.alias("far"), side.alias("side"), F.shiftright("state", 2).alias("free"))
    return found.distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, small: int = SMALL) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text)."""
    rows = C.settle(fingerprints(docs, k), "fingerprints")
    marks = C.settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "marks")
    labels = components(C.settle(links(marks, small), "links"))
    # Components of one row need no name but its own id, so only the others are joined with the rows.
    named = marks.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("c", "fp").alias("c"))
    named = C.settle(named, "named")
    ids = named.groupBy(F.col("c").alias("k")).agg(F.min("first").alias("component_id"), F.sum("n").alias("rows")).filter("rows > 1")
    many = named.join(ids, F.col("c") == F.col("k")).select(F.col("fp").alias("f"), "component_id", F.lit(True).alias("many"))
    found = rows.join(C.settle(many, "many"), F.col("fp") == F.col("f"), "left")
    own = F.when(F.col("many"), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
