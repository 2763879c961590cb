"""Exact top-M search that skips parts of the gallery which can't hold any of the best M.

The gallery is dealt to clusters once; each has a centre and a radius.  No row of a cluster is more similar to a query than
``query . centre + |query| * radius``, so a cluster is skipped if that is below the least of the M similarities that are known
already, first those of the cluster whose centre is most similar.  Results are those of a search of all pairs, ties included.

Scale: centres are fitted on a sample of bounded size (they decide the speed, never the result), every row is indexed.  The
gallery is cut into slices of ``SLICE_BYTES`` of vectors by the hash of its ids, so that a slice has its share of every cluster, the
queries into chunks of ``QUERY_BYTES``.  A task holds one slice and one chunk and skips clusters on its own.  A query is shuffled once for each
slice, a gallery row once for each chunk, however many clusters are visited; what a task finds is one array of M at most for each query and
class set, and those are merged only if there are several slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that centres are fitted on, rounds of fitting, rows a cluster is to have, and clusters at most.
SAMPLE_ROWS = 20_000
ROUNDS = 4
CLUSTER_ROWS = 512
MOST_CENTRES = 1024
#: Bytes of vectors in a gallery slice, in a chunk of queries, and in the gallery rows of one product.
SLICE_BYTES = 50_000_000
QUERY_BYTES = 32_000_000
BLOCK_BYTES = 500_000
#: Chunks that there are at least, if each has ``CHUNK_ROWS`` queries.
LEAST_CHUNKS = 12
CHUNK_ROWS = 1024
#: Queries that are searched at once, and their class sets times classes at most.
GROUP_ROWS = 2048
MOST_ALLOWED = 32_000_000
KEY = ["query_split", "query_idx"]
FOUND = "query_split string, query_idx long, true_class int, k int, found array<struct<example_idx:long,class_idx:int,similarity:double>>"
WORK = "round int, block int, queries long, gallery_rows long"


def vectors(column: pa.Array | pa.ChunkedArray, half: bool = False) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return out.astype(np.float16).astype(np.float64) if half else out


def fit_centres(gallery: DataFrame, n_rows: int, k: int) -> np.ndarray:
    """k centres of a sample of the gallery, drawn by hash."""
    share = min(1.0, SAMPLE_ROWS / max(n_rows, 1))
    drawn = F.pmod(F.xxhash64(F.lit("centres"), "split", "example_idx"), F.lit(1 << 20)) < share * (1 << 20)
    sample = gallery.filter(drawn).select("vec").limit(2 * SAMPLE_ROWS).toArrow()
    x = vectors(sample.column("vec")) if len(sample) else np.zeros((0, 1))
    x = np.unique(x[np.isfinite(x).all(1)], axis=0)
    if len(x) <= k:
        return x
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, by blocks of rows."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64)] + [(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)])


def build(gallery: DataFrame, n: int, width: int, clusters: int | None = None) -> tuple[np.ndarray, DataFrame]:
    """Centres of ``gallery`` (split, example_idx, class_idx, vec), and its rows with their cluster; clusters of about ``CLUSTER_ROWS`` rows if not given."""
    k = clusters or max(1, min(MOST_CENTRES, n // CLUSTER_ROWS))
    centres = fit_centres(gallery, n, k)
    if not len(centres):
        centres = np.zeros((1, max(width, 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column("vec")) if batch.num_rows else np.zeros((0, centres.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(x, centres), pa.int32())], [*batch.schema.names, "cluster"])

    plain = gallery.select("split", F.col("example_idx").cast("long").alias("example_idx"), F.col("class_idx").cast("int").alias("class_idx"), "vec")
    return centres, plain.mapInArrow(assign, "split string, example_idx long, class_idx int, vec array<double>, cluster int")


def search(
    gallery: DataFrame, queries: DataFrame, m: int, exclude_self: str, exclude_same_class: bool, half: bool, clusters: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(found, work) for ``queries`` (split, example_idx, class_idx, vec, asked: structs of k and classes).

    ``found`` has one row a query and class set with any candidate, its array ``found`` in pool order.  ``work`` has the numbers of queries and of gallery rows
    of each product: of round 1 for the nearest cluster, of round 2 for others; it's computed anew when asked for.
    """
    n, width = gallery.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    row = 8 * max(width or 1, 1)
    asking = queries.count()
    slices = max(1, -(-n * row // SLICE_BYTES))
    chunks = max(1, -(-asking * row // QUERY_BYTES), min(LEAST_CHUNKS, -(-asking // CHUNK_ROWS)))
    centres, rows = build(gallery, n, width or 1, clusters)
    own = lambda parts: F.pmod(F.xxhash64("split", "example_idx"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = queries.select("split", F.col("example_idx").cast("long").alias("example_idx"), F.col("class_idx").cast("int").alias("class_idx"), "vec", "asked")
    left = a.select(*[F.col(c).alias(f"x_{c}") for c in a.columns], own(chunks).alias("chunk")).withColumn("slice", every(slices))
    right = rows.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns], own(slices).alias("slice")).withColumn("chunk", every(chunks))
    met = left.groupBy("chunk", "slice").cogroup(right.groupBy("chunk", "slice"))

    def find(a: pa.Table, b: pa.Table) -> pa.Table:
        return _Meeting(a, b, centres, m, exclude_self, exclude_same_class, half).found()

    def tell(a: pa.Table, b: pa.Table) -> pa.Table:
        meeting = _Meeting(a, b, centres, m, exclude_self, exclude_same_class, half)
        meeting.found()
        return pa.table({c: pa.array([w[i] for w in meeting.work], kind) for i, (c, kind) in enumerate((("round", pa.int32()), ("block", pa.int32()), ("queries", pa.int64()), ("gallery_rows", pa.int64())))})

    found = met.applyInArrow(find, FOUND)
    if slices > 1:
        parts = found.groupBy(*KEY, "true_class", "k").agg(F.flatten(F.collect_list("found")).alias("found"))
        ordered = F.array_sort(F.transform("found", lambda x: F.struct((-x["similarity"]).alias("less"), x["example_idx"].alias("example_idx"), x.alias("x"))))
        found = parts.withColumn("found", F.transform(F.slice(ordered, 1, m), lambda o: o["x"]))
    return found, met.applyInArrow(tell, WORK)


def best_of(sims: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the m greatest of each row, without -inf; ties go to the lower column."""
    keep = min(m, sims.shape[1])
    edge = -np.partition(-sims, keep - 1, axis=1)[:, keep - 1 : keep]
    above, tied = sims > edge, sims == edge
    tied &= np.cumsum(tied, axis=1) <= keep - above.sum(1, keepdims=True)
    return np.nonzero((above | tied) & (sims > -np.inf))


class _Meeting:
    """One chunk of queries and one slice of the gallery, its rows in order of cluster and id."""

    def __init__(self, a: pa.Table, b: pa.Table, centres: np.ndarray, m: int, exclude_self: str, exclude_same_class: bool, half: bool):
        a, b = (t.rename_columns([c.removeprefix("x_") for c in t.column_names]) for t in (a, b))
        self.m, self.exclude_self, self.exclude_same_class, self.half = m, exclude_self, exclude_same_class, half
        self.work: list[tuple] = []
        self.size = len(a) if len(b) else 0
        if not self.size:
            return
        cluster, ids = b.column("cluster").to_numpy(), b.column("example_idx").to_numpy()
        order = np.lexsort((ids, cluster))
        self.ids, self.g = ids[order], vectors(b.column("vec"), half)[order]
        self.classes, self.splits = b.column("class_idx").to_numpy()[order], np.array(b.column("split").to_pylist())[order]
        cluster = cluster[order]
        self.starts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
        self.ends = np.r_[self.starts[1:], len(cluster)]
        self.place = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        self.longest = np.abs(self.g).max(initial=0.0) * np.sqrt(self.g.shape[1])
        self.clusters, self.centres = cluster[self.starts], centres[cluster[self.starts]]
        self.radii = np.array([np.sqrt(((self.g[s:e] - c) ** 2).sum(1).max()) for s, e, c in zip(self.starts, self.ends, self.centres)])
        self.step = max(1, BLOCK_BYTES // (8 * max(self.g.shape[1], 1)))
        x = vectors(a.column("vec"), half)
        near = [(x[i : i + GROUP_ROWS] @ self.centres.T).argmax(1) for i in range(0, len(x), GROUP_ROWS)]
        home = np.concatenate(near)
        order = np.argsort(home, kind="stable")  # queries of one direction are searched at once
        self.home, self.x = home[order], x[order]
        self.query = {c: np.array(a.column(c).to_pylist())[order] for c in ("split", "example_idx", "class_idx")}
        asked = a.column("asked").to_pylist()
        self.asked = [asked[i] for i in order]
        self.plain = not exclude_same_class and all(s["classes"] is None for row in asked for s in row)
        self.known, self.code = (np.zeros(1, np.int64), np.zeros(len(self.ids), np.int64)) if self.plain else np.unique(self.classes, return_inverse=True)

    def found(self) -> pa.Table:
        out: list[tuple] = []
        at = 0
        while at < self.size:
            rounds = max(map(len, self.asked[at : at + GROUP_ROWS]), default=0)
            most = min(GROUP_ROWS, 65_536 // max(rounds, 1), MOST_ALLOWED // max(len(self.known) * rounds, 1))
            upto = min(self.size, at + max(most, 1))
            if rounds:
                out.append(self._group(at, upto, rounds))
            at = upto
        row, k, n, place, sims = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 5))
        place = place.astype(np.int64)
        one = pa.StructArray.from_arrays(
            [pa.array(self.ids[place], pa.int64()), pa.array(self.classes[place], pa.int32()), pa.array(sims, pa.float64())] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.float64())],
            ["example_idx", "class_idx", "similarity"],
        )
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), one)
        q = {c: v[row] for c, v in self.query.items()} if out else {c: [] for c in ("split", "example_idx", "class_idx")}
        return pa.table({
            "query_split": pa.array(q["split"], pa.string()), "query_idx": pa.array(q["example_idx"], pa.int64()), "true_class": pa.array(q["class_idx"], pa.int32()),
            "k": pa.array(list(k), pa.int32()), "found": lists,
        })

    def _group(self, at: int, upto: int, rounds: int) -> tuple:
        """(query, k, number found, and flat: place in the gallery, similarity) of the queries ``at`` to ``upto``."""
        n, m = upto - at, self.m
        x, home, asked = self.x[at:upto], self.home[at:upto], self.asked[at:upto]
        ids, splits, own_class = (self.query[c][at:upto] for c in ("example_idx", "split", "class_idx"))
        exists = np.array([[r < len(row) for r in range(rounds)] for row in asked])
        allowed = np.repeat(exists[:, :, None], len(self.known), 2)
        if not self.plain:
            limited = [(i, r, some["classes"]) for i, row in enumerate(asked) for r, some in enumerate(row) if some["classes"] is not None]
            if limited:
                i, r, n_classes = (np.array(c) for c in zip(*((i, r, len(some)) for i, r, some in limited)))
                allowed[i, r] = False
                some = np.array([c for *_, some in limited for c in some if c is not None], dtype=np.int64)
                n_classes = np.array([sum(c is not None for c in some) for *_, some in limited]) if len(some) < n_classes.sum() else n_classes
                at_class = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
                hit = self.known[at_class] == some
                allowed[np.repeat(i, n_classes)[hit], np.repeat(r, n_classes)[hit], at_class[hit]] = True
            if self.exclude_same_class:
                allowed &= (self.known[None, :] != own_class[:, None])[:, None, :]
        least = np.full((n, rounds), -np.inf)  # the least of the m best so far, by query and class set
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query and class set, place in the gallery, similarity: sorted
        new: list[tuple] = []
        waiting = 0

        def bounds() -> np.ndarray:
            """The least similarity that any class set of a query can use, by class."""
            return np.where(allowed, least[:, :, None], np.inf).min(1)

        def settle() -> None:
            nonlocal best, new, waiting, bound
            row, place, sims = (np.concatenate(c) for c in zip(best, *new))
            order = np.argsort(-sims)
            order = order[np.argsort(row[order].astype(np.uint16 if n * rounds <= 65_536 else np.int64), kind="stable")]
            r, s = row[order], sims[order]
            if ((r[1:] == r[:-1]) & (s[1:] == s[:-1])).any():  # ties go to the lower id
                order = np.lexsort((self.ids[place], -sims, row))
            row, place, sims = row[order], place[order], sims[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            last = rank == m - 1
            least.reshape(-1)[row[last]] = sims[last]
            best, new, waiting = [c[rank < m] for c in (row, place, sims)], [], 0
            bound = bounds()

        # What rounding can do to a sum of products, and 16 bits to a similarity: equal vectors are to tie, wherever they are in a matrix.
        length = np.sqrt((x * x).sum(1))
        slack = np.nan_to_num(1e-15 * max(x.shape[1], 4) * length * self.longest)

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            sims = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", x[i[at : at + 50_000]], self.g[j[at : at + 50_000]]) for at in range(0, len(i), 50_000)])
            return sims.astype(np.float16).astype(np.float64) if self.half else sims

        def multiply(some: np.ndarray | None, start: int, end: int) -> None:
            """Candidates of all queries, or ``some``, among the gallery's rows from ``start``; all leave out the rows of their nearest cluster."""
            nonlocal waiting
            of = np.arange(n) if some is None else some
            vec = x if some is None else x[some]
            for s in range(start, end, self.step):
                e = min(s + self.step, end)
                low = bound[of] - slack[of][:, None]
                low = low - 2.0**-10 * np.maximum(np.abs(low), 2.0**-14) if self.half else low
                near = vec @ self.g[s:e].T >= (low if self.plain else low.take(self.code[s:e], axis=1))
                i, j = np.divmod(np.flatnonzero(near), e - s)
                if len(i) > 4 * m * len(of):  # many: the m best of each come first, of equal ones the lower ids
                    order = s + np.argsort(self.ids[s:e], kind="stable")
                    for part in np.array_split(of, max(1, len(of) * len(order) // 500_000)):
                        sims = exact(np.repeat(part, len(order)), np.tile(order, len(part))).reshape(len(part), -1)
                        wrong = self._own(ids[part][:, None], splits[part][:, None], self.ids[None, order], self.splits[None, order])
                        if some is None:
                            wrong |= home[part][:, None] == self.place[None, order]
                        sims[wrong] = -np.inf
                        for r in range(rounds):
                            i, j = best_of(np.where(allowed[part, r][:, self.code[order]], sims, -np.inf), m)
                            new.append((part[i] * rounds + r, order[j], sims[i, j]))
                            waiting += len(i)
                else:
                    i, j = of[i], s + j
                    good = ~self._own(ids[i], splits[i], self.ids[j], self.splits[j])
                    if some is None:
                        good &= home[i] != self.place[j]
                    i, j = i[good], j[good]
                    sims = exact(i, j)
                    h, r = np.nonzero(allowed[i, :, self.code[j]] & (sims[:, None] >= least[i]) & (sims[:, None] > -np.inf))
                    new.append((i[h] * rounds + r, j[h], sims[h]))
                    waiting += len(h)
                if waiting > n * rounds * m:
                    settle()

        bound = bounds()
        edges = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True])
        for a, b in zip(edges, edges[1:]):
            c = home[a]
            multiply(np.arange(a, b), self.starts[c], self.ends[c])
            self.work.append((1, int(self.clusters[c]), int(b - a), int(self.ends[c] - self.starts[c])))
        if new:
            settle()
        near = x @ self.centres.T
        far = length[:, None] * self.radii
        reach = near + far
        reach = reach + 1e-9 * (np.abs(near) + far) + 1e-300 + (2.0**-10 * np.maximum(np.abs(reach), 2.0**-14) if self.half else 0)
        order = np.argsort(-near.mean(0), kind="stable")
        if not (reach < bound.min(1)[:, None]).mean() > 0.5:
            # Little can be skipped: all rows, however they are clustered.
            multiply(None, 0, len(self.ids))
            self.work.append((2, -1, n, len(self.ids)))
        else:
            for c in order:
                present = np.unique(self.code[self.starts[c] : self.ends[c]])
                some = np.flatnonzero(~(reach[:, c] < bound[:, present].min(1)) & (home != c))
                if len(some):
                    multiply(some, self.starts[c], self.ends[c])
                    self.work.append((2, int(self.clusters[c]), len(some), int(self.ends[c] - self.starts[c])))
        if new:
            settle()
        row, place, sims = best
        rows, counts = np.unique(row, return_counts=True)
        k = np.array([asked[i // rounds][i % rounds]["k"] for i in rows], dtype=object)
        return at + rows // rounds, k, counts, place, sims

    def _own(self, ids: np.ndarray, splits: np.ndarray, other_ids: np.ndarray, other_splits: np.ndarray) -> np.ndarray:
        """Where a query meets its own row and mustn't."""
        same = (ids == other_ids) & (self.exclude_self != "never")
        return same & (splits == other_splits) if self.exclude_self == "same_split" else same
