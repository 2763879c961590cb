"""Exact top-M retrieval and what is derived from pools.

Order is (similarity descending, id ascending) at every step, so ties always go to the lower id.  A query is known by
(query_split, query_idx): ids may repeat from split to split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources import scratch
from . import neighbours
from .sampling import draw

#: Rows of a block of queries and of a block of gallery rows at most (one task multiplies two blocks), rows below which a side
#: isn't cut into four, and gallery rows of one product.
BLOCK_ROWS = 4096
SMALL_ROWS = 256
STEP_ROWS = 1024
#: Rows of a block of cosines, whose pairs are all written.
COSINE_ROWS = 1024
#: Gallery rows up to which all pairs are multiplied.
PLAIN_ROWS = 20_000
POOL = "query_split string, query_idx long, true_class int, k int, example_idx long, class_idx int, similarity double"
QUERY = ["query_split", "query_idx"]


def _blocks(n: int) -> int:
    return max(-(-n // BLOCK_ROWS), min(4, -(-n // SMALL_ROWS)), 1)


def _dealt(rows: DataFrame, n: int, others: int) -> DataFrame:
    """Each row with its block and once for every block of the other side, all columns new (both sides may be one table)."""
    own = F.pmod(F.xxhash64("split", "example_idx"), F.lit(n)).cast("int")
    renamed = rows.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns], own.alias("own"))
    return renamed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def top_m(
    queries: DataFrame, gallery: DataFrame, m: int, exclude_self: str = "same_split", exclude_same_class: bool = False, half: bool = False,
    sets: DataFrame | None = None, clusters: int | None = None,
) -> DataFrame:
    """The m most similar gallery rows for each query row (fewer if there are fewer).

    Both have split, example_idx, class_idx, vec; a query never meets its own row of the same split (``same_split``) or id
    (``always``) unless ``never`` is given.  ``half`` rounds vectors and similarities to 16 bits before ordering.  With ``sets``
    (query_split, query_idx, k, classes) the m are those among the gallery rows of these classes, ranked over the whole gallery, once
    for each k; null classes allow all, an empty set gives an empty pool.

    A gallery of up to ``PLAIN_ROWS`` rows is searched whole: both sides are cut into blocks by the hash of their ids; a task multiplies
    one block of each (at most ``STEP_ROWS`` gallery rows at once) and keeps its best m for each query and k, so that m rows for
    each query, k and gallery block are shuffled.  Larger ones are indexed by clusters (``neighbours``; ``clusters`` sets their
    number, 0 none), and clusters that can't hold any of the best m are skipped; the result is the same.  No vectors but the centres' sample
    go through the driver.
    """
    return searched(queries, gallery, m, exclude_self, exclude_same_class, half, sets, clusters)[0]


def searched(
    queries: DataFrame, gallery: DataFrame, m: int, exclude_self: str = "same_split", exclude_same_class: bool = False, half: bool = False,
    sets: DataFrame | None = None, clusters: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """``top_m``, and the work done by an indexed search (round, block, queries, gallery_rows), None for a plain one."""
    q = queries.select("split", "example_idx", "class_idx", F.col("vec").cast("array<double>").alias("vec"))
    if sets is None:
        q = q.withColumn("asked", F.array(F.struct(F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<int>").alias("classes"))))
    else:
        asked = sets.groupBy(*QUERY).agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), F.col("classes").cast("array<int>").alias("classes"))).alias("asked"))
        asked = asked.withColumnsRenamed({"query_split": "split", "query_idx": "example_idx"})
        # Class sets are small as files, not in memory: they are never broadcast.
        q = q.join(asked.hint("merge"), ["split", "example_idx"])
    g = gallery.select("split", "example_idx", "class_idx", F.col("vec").cast("array<double>").alias("vec"))

    size = gallery.count()
    keys = [*QUERY, "k"] if sets is not None else QUERY
    if clusters == 0 or not size or (clusters is None and size <= PLAIN_ROWS):

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            parts = [_search(a.slice(at, BLOCK_ROWS), b, m, exclude_self, exclude_same_class, half) for at in range(0, max(len(a), 1), BLOCK_ROWS)]
            return pa.concat_tables(parts)

        n, l = _blocks(queries.count()), _blocks(size)
        left, right = _dealt(q, n, l), _dealt(g, l, n)
        found = left.groupBy("own", "other").cogroup(right.groupBy("other", "own")).applyInArrow(search, POOL)
        return numbered(found if sets is not None else found.drop("k"), keys).filter(F.col("position") < m), None
    lists, work = neighbours.search(g, q, m, exclude_self, exclude_same_class, half, clusters)
    found = lists.select(*keys, "true_class", F.posexplode("found").alias("position", "x"))
    return found.select(*QUERY, "true_class", *keys[2:], "x.*", "position"), work


def _search(a: pa.Table, b: pa.Table, m: int, exclude_self: str, exclude_same_class: bool, half: bool) -> pa.Table:
    """The best m rows of gallery block ``b`` for every query and class set of block ``a``."""
    out: list[tuple] = []
    if len(a) and len(b):
        a, b = (x.rename_columns([c.removeprefix("x_") for c in x.column_names]) for x in (a, b))
        b = b.take(np.argsort(b.column("example_idx").to_numpy(), kind="stable"))
        query = {c: np.array(a.column(c).to_pylist()) for c in ("split", "example_idx", "class_idx")}
        asked = a.column("asked").to_pylist()
        vectors = neighbours.vectors(a.column("vec"), half)
        rounds = max(map(len, asked))
        best: list[list[tuple]] = [[] for _ in range(rounds)]
        for at in range(0, len(b), STEP_ROWS):
            part = b.slice(at, STEP_ROWS)
            ids, classes = part.column("example_idx").to_numpy(), part.column("class_idx").to_numpy()
            sims = vectors @ neighbours.vectors(part.column("vec"), half).T
            if half:
                sims = sims.astype(np.float16).astype(np.float64)
            if exclude_self != "never":
                own = query["example_idx"][:, None] == ids[None, :]
                if exclude_self == "same_split":
                    own &= query["split"][:, None] == np.array(part.column("split").to_pylist())[None, :]
                sims[own] = -np.inf
            if exclude_same_class:
                sims[query["class_idx"][:, None] == classes[None, :]] = -np.inf
            known, code = np.unique(classes, return_inverse=True)
            for r in range(rounds):
                rows = np.array([i for i, x in enumerate(asked) if len(x) > r])
                allowed = np.zeros((len(rows), len(known)), bool)
                for i, row in enumerate(rows):
                    some = asked[row][r]["classes"]
                    allowed[i] = True if some is None else np.isin(known, some)
                own = np.where(allowed[:, code], sims[rows], -np.inf)
                i, j = neighbours.best_of(own, m)
                best[r].append((rows[i], ids[j], classes[j], own[i, j]))
        for r, parts in enumerate(best):
            row, ids, classes, sims = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, -sims, row))
            row, ids, classes, sims = row[order], ids[order], classes[order], sims[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            some = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < m
            row = row[some]
            k = [asked[i][r]["k"] for i in row]
            out.append((query["split"][row], query["example_idx"][row], query["class_idx"][row], k, ids[some], classes[some], sims[some]))
    names = [c.split()[0] for c in POOL.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
    columns = [pa.concat_arrays([pa.array(x[i], kind) for x in out]) if out else pa.array([], kind) for i, kind in enumerate(kinds)]
    return pa.table(dict(zip(names, columns)))


def numbered(pool: DataFrame, keys: list[str] = QUERY) -> DataFrame:
    """``position`` from 0 within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "example_idx")
    return pool.withColumn("position", F.row_number().over(w) - 1)


def maintained(pool: DataFrame, queries: DataFrame, gallery: DataFrame, added: DataFrame, removed: DataFrame, m: int, **options) -> tuple[DataFrame, DataFrame]:
    """(pools, recomputed) of ``queries`` after a change of the gallery, from the stored ``pool`` of the gallery before it.

    ``gallery`` is the one after the change, ``added`` (as ``gallery``) and ``removed`` (example_idx) what came and went; a changed row is in both.
    Queries whose pool lost a member are searched anew in the whole gallery, as is a query without a stored pool; all others meet the
    added rows only, and their best m are merged with the stored ones.  Equal to a rebuild, ties included.  ``recomputed`` has the
    keys of the queries that were searched anew.  ``options`` are those of ``top_m`` (without sets), the same as for the stored pool.
    """
    columns = [*QUERY, "true_class", "example_idx", "class_idx", "similarity"]
    keys = queries.select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"))
    lost = pool.join(removed.select("example_idx").distinct(), "example_idx", "left_semi").select(*QUERY)
    new = keys.join(pool.select(*QUERY), QUERY, "left_anti")
    anew = scratch.settle(lost.unionByName(new).distinct(), "searched-anew")
    of = anew.withColumnsRenamed({"query_split": "split", "query_idx": "example_idx"})
    some = top_m(queries.join(of, ["split", "example_idx"], "left_semi"), gallery, m, **options)
    others = queries.join(of, ["split", "example_idx"], "left_anti")
    met = top_m(others, added, m, **options)
    stored = pool.join(keys, QUERY, "left_semi").join(anew, QUERY, "left_anti")
    merged = numbered(stored.select(*columns).unionByName(met.select(*columns))).filter(F.col("position") < m)
    return some.select(*columns, "position").unionByName(merged.select(*columns, "position")), anew


def top_m_builtin(queries: DataFrame, gallery: DataFrame, m: int) -> DataFrame:
    """``top_m`` with built-in functions only (every pair is a row); the readable twin for tests and small galleries."""
    q = queries.select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"), F.col("class_idx").alias("true_class"), F.col("vec").alias("qv"))
    pairs = q.join(gallery, ~((F.col("query_split") == F.col("split")) & (F.col("query_idx") == F.col("example_idx"))))
    sims = pairs.select("query_split", "query_idx", "true_class", "example_idx", "class_idx", V.dot(F.col("qv"), F.col("vec")).alias("similarity"))
    return numbered(sims).filter(F.col("position") < m)


def cosines(queries: DataFrame, gallery: DataFrame, digits: int) -> DataFrame:
    """query_idx, example_idx and the rounded cosine of every pair; null if a vector has no length, or the two have different ones.

    Both have example_idx and vec.  A task multiplies one block of each side, ``COSINE_ROWS`` rows at most; what is written is quadratic by nature.
    """
    n, l = (max(1, -(-side.count() // COSINE_ROWS)) for side in (queries, gallery))

    def dealt(rows: DataFrame, own: int, others: int) -> DataFrame:
        x = rows.select(F.col("example_idx").alias("x_example_idx"), F.col("vec").alias("x_vec"), F.pmod(F.xxhash64("example_idx"), F.lit(own)).alias("own"))
        return x.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with zeros behind, and their sizes (-1: null, or with a null in it)."""
        x = column.combine_chunks()
        size = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = x.flatten()
        full = np.arange(max(size.max(initial=0), 0)) < size[:, None]
        out = np.zeros(full.shape)
        out[full] = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
        if flat.null_count:
            size[np.unique(np.repeat(np.arange(len(size)), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)])] = -1
        return out, size

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        (x, own), (y, other) = padded(a.column("x_vec")), padded(b.column("x_vec"))
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
        length = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        none = (length == 0) | (own[:, None] != other[None, :]) | (own < 0)[:, None]
        with np.errstate(all="ignore"):
            c = x @ y.T / length * 10.0**digits
            c = np.trunc(c + np.copysign(0.5, c)) / 10.0**digits + 0.0
        ids, others = a.column("x_example_idx"), b.column("x_example_idx")
        i, j = np.divmod(np.arange(c.size), max(len(y), 1))
        return pa.table({"query_idx": ids.take(pa.array(i)), "example_idx": others.take(pa.array(j)), "cosine": pa.array(c.ravel(), mask=none.ravel() if none.any() else None)})

    met = dealt(queries, n, l).groupBy("own", "other").cogroup(dealt(gallery, l, n).groupBy("other", "own"))
    return met.applyInArrow(multiply, "query_idx long, example_idx long, cosine double")


def restricted(queries: DataFrame, gallery: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The first k gallery rows of each query whose class is in the query's set, over the whole gallery, for every set size."""
    return top_m(queries, gallery, k, sets=sets)


def top_one(pool: DataFrame, keys: list[str] = ["query_split", "query_idx"]) -> DataFrame:
    """The first exemplar with its class and similarity, by an aggregate instead of a sort."""
    best = F.max_by(F.struct("example_idx", "class_idx", "similarity"), F.struct("similarity", -F.col("example_idx")))
    return pool.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def pool_facts(pool: DataFrame, keys: list[str] = QUERY) -> DataFrame:
    """Size, whether the true class is in the pool, whether the first exemplar is of the true class; for restricted pools by k too."""
    same = F.col("class_idx") == F.col("true_class")
    return pool.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pool_size"), F.bool_or(same).alias("has_true"),
        F.max_by(same, F.struct("similarity", -F.col("example_idx"))).alias("top1_same_class"),
    )


def controls(queries: DataFrame, gallery: DataFrame, sets: DataFrame, seed: int, pool_size: int) -> DataFrame:
    """For each query and class set (query_split, query_idx, k, classes): four selectors without a model.

    The first exemplar within the set and a member of the set's pool (its first ``pool_size``) drawn by a hash, the first of all
    (and whether its class is in the set), the first of the true class; each ranked over the whole gallery.  What doesn't exist
    is null.
    """
    return with_facts(queries, gallery, sets, seed, pool_size).select(*QUERY, "k", "restricted_top1", "top1", "top1_in_options", "same_class_top1", "random_member")


def with_facts(queries: DataFrame, gallery: DataFrame, sets: DataFrame, seed: int, pool_size: int) -> DataFrame:
    """``controls`` and ``pool_facts`` of each class set's pool, by one search."""
    q = queries.select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"), F.col("class_idx").alias("own"))
    everything = q.select(*QUERY, F.lit(-1).alias("k"), F.lit(None).cast("array<int>").alias("classes"))
    same_class = q.select(*QUERY, F.lit(-2).alias("k"), F.array("own").alias("classes"))
    own = sets.select(*QUERY, F.col("k").cast("int").alias("k"), F.col("classes").cast("array<int>").alias("classes"))
    found = top_m(queries, gallery, pool_size, sets=own.unionByName(everything).unionByName(same_class))
    same = F.col("class_idx") == F.col("true_class")
    drawn = F.min_by("example_idx", F.when(F.col("k") > 0, draw(seed, "query_idx", "k", "example_idx")))
    # One row a query and class set is kept, so that the search runs once.
    each = scratch.settle(found.groupBy(*QUERY, "k").agg(
        F.min_by("example_idx", "position").alias("restricted_top1"), F.min_by("class_idx", "position").alias("first_class"), drawn.alias("random_member"),
        F.count(F.lit(1)).alias("pool_size"), F.bool_or(same).alias("has_true"), F.min_by(same, "position").alias("top1_same_class"),
    ), "controls")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    free = each.filter("k < 0").groupBy(*QUERY).agg(at(-1, "restricted_top1").alias("top1"), at(-1, "first_class").alias("__class"), at(-2, "restricted_top1").alias("same_class_top1"))
    x = own.join(each.filter("k > 0").hint("merge"), [*QUERY, "k"], "left").join(free.hint("merge"), QUERY, "left")
    in_options = F.when(F.col("__class").isNotNull(), F.array_contains("classes", F.col("__class")))
    return x.withColumn("top1_in_options", in_options).drop("classes", "first_class", "__class")


def pool_prefix(pool: DataFrame, m: int, strict: bool = True) -> DataFrame:
    """The first m of each pool with the rank as a fraction; a shorter pool is an error if ``strict``."""
    kept = pool.filter(F.col("position") < m).withColumn("rank_fraction", F.col("position") / F.lit(float(max(m - 1, 1))))
    if strict:
        n = F.count(F.lit(1)).over(Window.partitionBy("query_split", "query_idx"))
        short = F.raise_error(F.lit(f"a pool has fewer than {m} exemplars"))
        kept = kept.withColumn("rank_fraction", F.when(n < m, short).otherwise(F.col("rank_fraction")))
    return kept


def assemble(pool: DataFrame, queries: DataFrame, gallery: DataFrame, class_vectors: DataFrame) -> DataFrame:
    """Attach query, candidate and candidate-class vectors by id; small sides are broadcast by Spark's own size check.

    ``gallery`` is the one split that the pool was drawn from.
    """
    q = queries.select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"), F.col("vec").alias("query_vec"))
    g = gallery.select("example_idx", F.col("vec").alias("example_vec"))
    c = class_vectors.select("class_idx", F.col("vec").alias("label_vec"))
    return pool.join(q, QUERY).join(g, "example_idx").join(c, "class_idx")


def scalar_features(assembled: DataFrame, m: int) -> DataFrame:
    """Query-label and candidate-label cosines, similarity, rank fraction."""
    return assembled.select(
        "query_split", "query_idx", "position", "example_idx",
        V.cosine(F.col("query_vec"), F.col("label_vec")).alias("query_label"),
        V.cosine(F.col("example_vec"), F.col("label_vec")).alias("example_label"),
        "similarity", (F.col("position") / F.lit(float(max(m - 1, 1)))).alias("rank_fraction"),
    )


def pool_features(pool: DataFrame, queries: DataFrame, gallery: DataFrame, class_vectors: DataFrame, m: int) -> DataFrame:
    """``scalar_features`` of ``assemble``, without a row of vectors a candidate.

    A candidate's cosine with its class is computed once, a query's once for each class in its pool; only numbers are joined to the pool.
    """
    c = class_vectors.select("class_idx", F.col("vec").alias("label_vec"))
    e = gallery.join(c, "class_idx").select("example_idx", V.cosine(F.col("vec"), F.col("label_vec")).alias("example_label"))
    q = queries.select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"), F.col("vec").alias("query_vec"))
    met = pool.select(*QUERY, "class_idx").distinct().join(q, QUERY).join(c, "class_idx")
    met = met.select(*QUERY, "class_idx", V.cosine(F.col("query_vec"), F.col("label_vec")).alias("query_label"))
    x = pool.join(e, "example_idx").join(met, [*QUERY, "class_idx"])
    return x.select(*QUERY, "position", "example_idx", "query_label", "example_label", "similarity", (F.col("position") / F.lit(float(max(m - 1, 1)))).alias("rank_fraction"))


def nest(pool: DataFrame) -> DataFrame:
    """One row a query with its candidates as arrays in pool order."""
    rows = F.array_sort(F.collect_list(F.struct("position", "example_idx", "class_idx", "similarity")))
    out = pool.groupBy("query_split", "query_idx", "true_class").agg(rows.alias("r"))
    return out.select("query_split", "query_idx", "true_class", *[F.col(f"r.{c}").alias(n) for c, n in (("example_idx", "examples"), ("class_idx", "classes"), ("similarity", "similarities"))])


def unnest(nested: DataFrame) -> DataFrame:
    x = nested.select("query_split", "query_idx", "true_class", F.posexplode(F.arrays_zip("examples", "classes", "similarities")).alias("position", "x"))
    return x.select("query_split", "query_idx", "true_class", "position", F.col("x.examples").alias("example_idx"), F.col("x.classes").alias("class_idx"), F.col("x.similarities").alias("similarity"))
