"""Incremental merge, resume checks, validation: results are tables of violations, empty if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vectors as V
from ..sources import scratch
from . import sampling


def merge(existing: DataFrame, shards: DataFrame, keys: list[str], sequence: str, declared: DataFrame | None = None) -> DataFrame:
    """The last record of each key (greatest ``sequence``; existing rows count as before all shards), declared keys only.

    An aggregate, so that partial results combine before the shuffle.
    """
    both = existing.withColumn(sequence, F.lit(-1).cast("long")).unionByName(shards.withColumn(sequence, F.col(sequence).cast("long")))
    if declared is not None:
        both = both.join(declared.select(*keys).distinct(), keys, "left_semi")
    rest = [c for c in both.columns if c not in keys]
    order = F.struct(sequence, *[c for c, kind in both.dtypes if c in rest and c != sequence and not kind.startswith("map")])
    last = F.max_by(F.struct(*rest), order)
    return both.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def pending(declared: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return declared.join(done, keys, "left_anti")


def completeness(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Each key's row count and whether it is the declared one."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("complete", F.col("n") == size)


def progress(done: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """One row: completed, target, whether complete."""
    c = done.join(declared, keys, "left_semi").agg(F.count_distinct(*keys).alias("completed"))
    t = declared.agg(F.count_distinct(*keys).alias("target"))
    return c.crossJoin(t).withColumn("complete", F.col("completed") == F.col("target"))


def resume_violations(stored: DataFrame, declared: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """(key columns, rule): repeated keys, keys outside the sample, changed values of columns that must not change."""
    twice = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit("duplicate").alias("rule"))
    outside = stored.join(declared, keys, "left_anti").select(*keys, F.lit("outside").alias("rule")).distinct()
    d = declared.select(*keys, *[F.col(c).alias(f"__{c}") for c in fixed])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in fixed])
    changed = stored.join(d, keys).filter(~same).select(*keys, F.lit("changed").alias("rule")).distinct()
    return twice.unionByName(outside).unionByName(changed)


def prefix_violations(stored: DataFrame, rebuilt: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Positions below ``size`` where the rebuilt pool differs from the stored one, or either lacks a row."""
    a = stored.filter(F.col("position") < size).select(*keys, "position", F.col("example_idx").alias("stored"), F.col("similarity").alias("stored_similarity"))
    b = rebuilt.filter(F.col("position") < size).select(*keys, "position", F.col("example_idx").alias("rebuilt"), F.col("similarity").alias("rebuilt_similarity"))
    return a.join(b, [*keys, "position"], "full").filter(~(F.col("stored").eqNullSafe(F.col("rebuilt")) & F.col("stored_similarity").eqNullSafe(F.col("rebuilt_similarity"))))


def expansion(stored: DataFrame, rebuilt: DataFrame, keys: list[str], old: int, new: int) -> DataFrame:
    """What is still to be scored when pools grow from ``old`` to ``new``; shrinking is refused."""
    if new < old:
        raise ValueError("a pool can't shrink")
    return rebuilt.filter(F.col("position") < new).join(stored.filter(F.col("position") < old), [*keys, "position"], "left_anti")


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-6) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def validate_teacher(records: DataFrame, k: int, pool_size: int, n_classes: int) -> DataFrame:
    """(query_split, query_idx, rule) for each broken rule of one-row-a-query teacher records.

    Columns: true_class, classes (label set), ranking (wrong classes), zero_scores, examples, example_classes, scores
    (one vector a candidate over the label set), margins.
    """
    c = F.col
    true = S.place_in(c("classes"), c("true_class"))
    margins = F.transform(c("scores"), lambda s: S.margin(s, true))
    rules = {
        "label_count": F.size("classes") == k,
        "labels_ascending": F.array_sort(F.array_distinct("classes")) == c("classes"),
        "true_class_in_labels": F.array_contains("classes", c("true_class")),
        "labels_in_range": F.forall("classes", lambda x: (x >= 0) & (x < n_classes)),
        "ranking_complete": (F.size(F.array_distinct("ranking")) == n_classes - 1) & ~F.array_contains("ranking", c("true_class")),
        "zero_scores_finite": (F.size("zero_scores") == k) & finite(c("zero_scores")),
        "pool_size": F.size("examples") == pool_size,
        "candidates_distinct": F.size(F.array_distinct("examples")) == F.size("examples"),
        "candidate_classes_in_range": F.forall("example_classes", lambda x: (x >= 0) & (x < n_classes)),
        "scores_finite": F.forall("scores", lambda s: (F.size(s) == k) & finite(s)),
        "no_self_retrieval": (c("query_split") != "train") | ~F.array_contains("examples", c("query_idx")),
        "margins_match": F.forall(F.zip_with(margins, "margins", lambda a, b: close(a, b)), lambda x: x),
    }
    checked = records.select("query_split", "query_idx", *[F.coalesce(v, F.lit(False)).alias(n) for n, v in rules.items()])
    return checked.unpivot(["query_split", "query_idx"], list(rules), "rule", "ok").filter("NOT ok").drop("ok")


#: Metrics of a teacher record, zero-shot and by candidate (fields of ``scores.teacher``), and the increments of candidates over zero-shot.
METRICS = ("correct", "true_rank", "true_score", "strongest_wrong", "strongest_wrong_score", "margin", "log_probability", "probability")
INCREMENTS = ("margin", "log_probability", "probability")


def teacher_metrics(records: DataFrame, temperature: float = 1.0) -> DataFrame:
    """``records`` with zero_metrics (struct) and metrics (an array of structs with increments), from zero_scores and scores over the label set.

    Null where the true class isn't among the labels or scores aren't as many as labels.
    """
    true = S.place_in(F.col("classes"), F.col("true_class"))
    fit = lambda s: F.array_contains("classes", F.col("true_class")) & (F.size("classes") > 1) & (F.size(s) == F.size("classes"))
    r = records.withColumn("zero_metrics", F.when(fit(F.col("zero_scores")), S.teacher(F.col("zero_scores"), true, temperature)))

    def full(s: Column) -> Column:
        more = lambda m: [(m[n] - F.col(f"zero_metrics.{n}")).alias(f"incremental_{n}") for n in INCREMENTS]
        return F.when(fit(s), V.let(S.teacher(s, true, temperature), lambda m: F.struct(*[m[n].alias(n) for n in METRICS], *more(m))))

    return r.withColumn("metrics", F.transform("scores", full))


def _same(a: Column, b: Column, kind: str) -> Column:
    return close(a, b) if kind == "double" else a == b


def record_rules(k: int, pool_size: int, n_classes: int) -> dict[str, Column]:
    """Every rule of a teacher record by name, true where it holds; of the columns of ``validate_teacher`` without margins, and

    label_similarities, similarities (of candidates), zero_metrics and metrics as in ``teacher_metrics``.
    """
    c = F.col
    within = lambda a: F.forall(a, lambda x: (x >= 0) & (x < n_classes))
    kinds = {"correct": "boolean", "true_rank": "int", "strongest_wrong": "int"}
    equal = lambda kind: lambda a, b: _same(a, b, kind)
    rules = {
        "label_count": (F.size("classes") == k) & (F.size(F.array_distinct("classes")) == k),
        "labels_ascending": F.array_sort(F.array_distinct("classes")) == c("classes"),
        "labels_in_range": within("classes"),
        "label_similarities": (F.size("label_similarities") == k) & finite(c("label_similarities")),
        "true_class_in_range": (c("true_class") >= 0) & (c("true_class") < n_classes),
        "true_class_in_labels": F.array_contains("classes", c("true_class")),
        "ranking_complete": (F.size("ranking") == n_classes - 1) & (F.size(F.array_distinct("ranking")) == n_classes - 1) & ~F.array_contains("ranking", c("true_class")),
        "ranking_in_range": within("ranking"),
        "zero_scores_finite": (F.size("zero_scores") == k) & finite(c("zero_scores")),
        "scores_finite": (F.size("scores") == pool_size) & F.forall("scores", lambda s: (F.size(s) == k) & finite(s)),
        "pool_size": F.size("examples") == pool_size,
        "candidates_distinct": F.size(F.array_distinct("examples")) == F.size("examples"),
        "candidate_classes_in_range": (F.size("example_classes") == pool_size) & within("example_classes"),
        "similarities_finite": (F.size("similarities") == pool_size) & finite(c("similarities")),
        "similarities_descending": F.sort_array("similarities", asc=False) == c("similarities"),
        "no_self_retrieval": (c("query_split") != "train") | ~F.array_contains("examples", c("query_idx")),
    }
    for n in METRICS:
        rules[f"zero_{n}"] = _same(c(f"zero_metrics.{n}"), c(f"__zero.{n}"), kinds.get(n, "double"))
    for n in (*METRICS, *(f"incremental_{n}" for n in INCREMENTS)):
        same = F.zip_with(c(f"metrics.{n}"), c(f"__metrics.{n}"), equal(kinds.get(n, "double")))
        rules[f"candidate_{n}"] = (F.size("metrics") == F.size("scores")) & F.forall(same, lambda x: x)
    return rules


def validate_records(records: DataFrame, k: int, pool_size: int, n_classes: int, temperature: float = 1.0) -> DataFrame:
    """(query_split, query_idx, rule) for each rule of ``record_rules`` that a record breaks; a value that is null breaks its rule.

    Metrics are computed anew from the scores and compared one by one (relative tolerance 1e-5, absolute 1e-6).
    """
    rules = record_rules(k, pool_size, n_classes)
    kept = records.withColumnsRenamed({"zero_metrics": "__given_zero", "metrics": "__given"})
    both = teacher_metrics(kept, temperature).withColumnsRenamed({"zero_metrics": "__zero", "metrics": "__metrics", "__given_zero": "zero_metrics", "__given": "metrics"})
    both = scratch.settle(both, "derived")  # else each rule would compute the metrics for itself
    checked = both.select("query_split", "query_idx", *[F.coalesce(v, F.lit(False)).alias(n) for n, v in rules.items()])
    return checked.unpivot(["query_split", "query_idx"], list(rules), "rule", "ok").filter("NOT ok").drop("ok")


def table_violations(vectors: DataFrame, pool: DataFrame, gallery_split: str = "train") -> DataFrame:
    """(rule, n): mixed dimensions, non-finite vectors, pool rows whose ids don't exist in the gallery, queries without a pool."""
    sizes = vectors.agg((F.count_distinct(F.size("vec")) - 1).alias("n")).select(F.lit("dimensions").alias("rule"), F.greatest(F.col("n"), F.lit(0)).alias("n"))
    odd = vectors.filter(~finite(F.col("vec"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("finite").alias("rule"), "n")
    gallery = vectors.filter(F.col("split") == gallery_split).select("example_idx")
    unknown = pool.join(gallery, "example_idx", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_id").alias("rule"), "n")
    queries = vectors.filter(F.col("split") != gallery_split).select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"))
    empty = queries.join(pool, ["query_split", "query_idx"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("empty_pool").alias("rule"), "n")
    return sizes.unionByName(odd).unionByName(unknown).unionByName(empty)


def dataset_violations(
    families: dict[str, DataFrame], labels: DataFrame, label_family: str, pool: DataFrame, gallery_split: str = "train", fewest: int = 1
) -> DataFrame:
    """(rule, n) of a ranking data set: what breaks each rule, 0 where it holds.

    ``families``: tables (split, example_idx, vec) of each kind of embedding; ``labels``: class_idx, vec, in the space of ``label_family``;
    ``pool``: query_split, query_idx, example_idx, class_idx, similarity, target.  Rules: one dimension a family, finite numbers, label vectors
    of their family's dimension, as many rows of every family in each split, queries and candidates that exist, classes that
    exist, finite similarities and targets, ``fewest`` candidates a query.
    """
    n = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    parts, counts = [], None
    for name, rows in families.items():
        widths = rows.select(F.size("vec").alias("w")).distinct()
        more = widths.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n"))
        parts += [more.select(F.lit(f"dimensions:{name}").alias("rule"), "n"), n(rows.filter(~F.coalesce(finite(F.col("vec")), F.lit(False))), f"finite:{name}")]
        own = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).withColumn("family", F.lit(name))
        counts = own if counts is None else counts.unionByName(own)
        if name == label_family:
            parts.append(n(labels.select(F.size("vec").alias("w")).distinct().join(widths, "w", "left_anti"), "label_dimensions"))
    uneven = counts.groupBy("split").agg(F.min("rows").alias("a"), F.max("rows").alias("b"), F.count(F.lit(1)).alias("families"))
    parts.append(n(uneven.filter((F.col("a") != F.col("b")) | (F.col("families") < len(families))), "row_counts"))
    whole = families[label_family].select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"))
    gallery = families[label_family].filter(F.col("split") == gallery_split).select("example_idx")
    parts += [
        n(pool.select("query_split", "query_idx").distinct().join(whole, ["query_split", "query_idx"], "left_anti"), "unknown_query"),
        n(pool.join(gallery, "example_idx", "left_anti"), "unknown_id"),
        n(pool.join(labels.select("class_idx").distinct(), "class_idx", "left_anti"), "class_range"),
        n(pool.filter(odd("similarity")), "similarity_finite"),
        n(pool.filter(odd("target")), "target_finite"),
        n(pool.groupBy("query_split", "query_idx").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") < fewest), "few_candidates"),
        n(whole.filter(F.col("query_split") != gallery_split).join(pool, ["query_split", "query_idx"], "left_anti"), "empty_pool"),
    ]
    return reduce(DataFrame.unionByName, parts)


def alignment(examples: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """(rule, n): examples without an embedding, embeddings without an example, more than one model."""
    a = examples.join(embeddings, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_embedding").alias("rule"), "n")
    b = embeddings.join(examples, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_example").alias("rule"), "n")
    m = embeddings.agg(F.count_distinct("model_name").alias("n")).select(F.lit("models").alias("rule"), F.greatest(F.col("n") - 1, F.lit(0)).alias("n"))
    return a.unionByName(b).unionByName(m)


def order_violations(stored: DataFrame, expected: DataFrame, place: str, value: str, rule: str = "class_order") -> DataFrame:
    """(rule, n): places where two ordered lists (of class names, of ids) differ or only one has a value."""
    a = stored.select(F.col(place).alias("p"), F.col(value).alias("a"), F.lit(1).alias("ha"))
    b = expected.select(F.col(place).alias("p"), F.col(value).alias("b"), F.lit(1).alias("hb"))
    differ = F.col("ha").isNull() | F.col("hb").isNull() | ~F.col("a").eqNullSafe(F.col("b"))
    return a.join(b, "p", "full").filter(differ).agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")


#: Buckets of the first level of a comparison by hashes, and parts of a bucket at each further level.
BUCKETS = 4096
PARTS = 64


def _marked(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` with a hash of the keys and two of keys and values; nulls count, as a hash passes them over."""
    whole = lambda cs: [x for c in cs for x in (F.col(f"`{c}`"), F.isnull(f"`{c}`"))]
    own = {"__k": F.xxhash64(*whole(keys)), **{f"__v{i}": F.xxhash64(F.lit(i), *whole([*keys, *values])) for i in (0, 1)}}
    return rows.withColumns(own)


def _unequal(a: DataFrame, b: DataFrame, bucket: Column) -> list[int]:
    """Buckets whose rows differ between two marked tables, by their number and the sums of both hashes (in halves, which can't overflow)."""
    half = lambda c, low: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(c, 32)
    halves = [half(f"__v{i}", low) for i in (0, 1) for low in (True, False)]
    sums = lambda rows, sign: rows.select(bucket.alias("b"), F.lit(sign).alias("n"), *[(sign * h).alias(f"s{i}") for i, h in enumerate(halves)])
    both = sums(a, 1).unionByName(sums(b, -1)).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3")])
    return [r.b for r in both.filter("n <> 0 OR s0 <> 0 OR s1 <> 0 OR s2 <> 0 OR s3 <> 0").select("b").collect()]


def where_unequal(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables in those buckets of ``keys`` where the tables differ; all differing rows and keys are among them.

    A tree of hashes: sums of two 64-bit hashes of all rows by bucket are compared, then by parts of the buckets that differ.  Only sums
    are shuffled, and the driver is sent the numbers of differing buckets, ``BUCKETS`` of the first level at most; it goes to a further
    level only while few buckets differ.  Equal tables come out empty without a row being moved.
    """
    left, right = _marked(a, keys, values), _marked(b, keys, values)
    size = BUCKETS
    for level in range(levels):
        bucket = F.pmod("__k", F.lit(size))
        unequal = _unequal(left, right, bucket)
        # A long list of buckets is as good as none.
        if len(unequal) <= BUCKETS // 4:
            left, right = (x.filter(bucket.isin(unequal)) if unequal else x.limit(0) for x in (left, right))
        if not unequal or len(unequal) > BUCKETS // PARTS:
            break
        size *= PARTS
    marks = ["__k", "__v0", "__v1"]
    return left.drop(*marks), right.drop(*marks)


def difference(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity; only what differs by its hashes is compared row by row."""
    columns = stored.columns
    stored, rebuilt = where_unequal(stored, rebuilt.select(*[f"`{c}`" for c in columns]), columns, [])
    return stored.exceptAll(rebuilt).withColumn("side", F.lit("stored")).unionByName(rebuilt.exceptAll(stored).withColumn("side", F.lit("rebuilt")))


def misaligned(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys in one table only, or whose values differ by more than the tolerance; only keys in buckets that differ are joined."""
    x, y = where_unequal(a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("a")), keys, ["a"])
    y = y.withColumnRenamed("a", "b")
    return x.join(y, keys, "full").filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def fingerprint(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """sha256 of each group's values in order; for groups that fit in a task."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    return rows.groupBy(by).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("fingerprint"))


def fingerprint_tree(rows: DataFrame, by: str, order: str, value: str, block: int = 50_000) -> DataFrame:
    """sha256 of each group's values in order, for groups of any size: of blocks of values, then of blocks of digests.

    Blocks are cut by place in the group, so that the result doesn't depend on partitions or on other groups.
    """
    keyed = rows.select(by, F.struct(by, order, F.col(value).cast("string").alias("v")).alias("__key"))
    placed = sampling.dense_index(keyed, "__key", "__place")
    first = placed.groupBy(by).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("n"))
    first = first.select(F.col(by).alias("__by"), "__first", "n")
    level = placed.join(first, F.col(by).eqNullSafe(F.col("__by"))).select(by, "n", (F.col("__place") - F.col("__first")).alias("at"), F.col("__key.v").alias("v"))
    for _ in range(3):
        values = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: F.coalesce(x["v"], F.lit("\0")))
        blocks = level.withColumn("block", F.floor(F.col("at") / block)).groupBy(by, "n", "block")
        level = blocks.agg(F.sha2(F.array_join(values, "\n"), 256).alias("v")).withColumnRenamed("block", "at")
    return level.select(by, F.col("v").alias("fingerprint"), "n")


def fingerprint_large(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The same purpose without gathering a group: the sums of two 64-bit hashes of every (place, value), and their number.

    A sum, other than an exclusive-or, doesn't cancel equal pairs; ``order`` is to be unique in its group.
    """
    part = lambda i: F.sum(F.xxhash64(F.lit(i), order, value).cast("decimal(38,0)"))
    n = F.count(F.lit(1))
    return rows.groupBy(by).agg(F.sha2(F.concat_ws(":", part(1).cast("string"), part(2).cast("string"), n.cast("string")), 256).alias("fingerprint"), n.alias("n"))


def top1_violations(pool: DataFrame, stored: DataFrame, done: DataFrame) -> DataFrame:
    """Queries (not done yet) whose rebuilt pool doesn't begin with the stored first exemplar."""
    first = pool.filter("position = 0").select("query_split", "query_idx", F.col("example_idx").alias("rebuilt"))
    s = stored.select("query_split", "query_idx", F.col("example_idx").alias("stored"))
    return s.join(done, ["query_split", "query_idx"], "left_anti").join(first, ["query_split", "query_idx"], "left").filter(~F.col("stored").eqNullSafe(F.col("rebuilt")))


def reuse(candidates: DataFrame, stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate's stored scores, else its new ones."""
    a = stored.select(*keys, F.col("scores").alias("__old"))
    b = new.select(*keys, F.col("scores").alias("__new"))
    x = candidates.join(a, keys, "left").join(b, keys, "left")
    return x.withColumn("scores", F.coalesce("__old", "__new")).withColumn("reused", F.col("__old").isNotNull()).drop("__old", "__new")
