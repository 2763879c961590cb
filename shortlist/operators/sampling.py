"""Splits and samples, seeded by hashes instead of a random stream.

Order within a class is that of md5(seed:key), so a sample is the same however the rows are partitioned and the same in
any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch


def draw(seed: int, *keys: str | Column) -> Column:
    """A random-looking order key for the row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def dense_index(rows: DataFrame, order: str, name: str = "index", partitions: int | None = None) -> DataFrame:
    """Number rows 0, 1, ... by ``order`` without one global window: range-partition, count, add offsets.

    The partitioned rows are written first: range bounds come from a sample, and counts and numbers must see the same ones.
    Ties in ``order`` never straddle partitions, so the numbering inside a partition is by a local sort.
    """
    spark = rows.sparkSession
    place = scratch.new(spark, "ranges")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()).write.parquet(place)
    parts = spark.read.parquet(place)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    local = Window.partitionBy("__part").orderBy(order)
    numbered = parts.withColumn("__at", F.row_number().over(local) - 1)
    return numbered.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__first") + F.col("__at")).cast("long")).drop("__part", "__first", "__at")


def read_parts(parts: list[DataFrame], order: str, name: str = "global_idx") -> DataFrame:
    """Concatenate parts (by column name) and give each row a stable global index: part by part, in order within one."""
    whole = None
    for i, part in enumerate(parts):
        keyed = part.withColumn("__key", F.struct(F.lit(i).alias("part"), F.col(order).alias("order")))
        whole = keyed if whole is None else whole.unionByName(keyed)
    return dense_index(whole, "__key", name).drop("__key")


def class_split(classes: DataFrame, column: str, train: float, val: float, seed: int) -> DataFrame:
    """Class-disjoint splits: the first floor(C * train) classes in drawn order, the next floor(C * val), the rest."""
    if train <= 0 or val < 0 or train + val > 1:
        raise ValueError("ratios must be positive and sum to 1 at most")
    names = classes.select(column).distinct()
    drawn = names.withColumn("__rn", F.row_number().over(Window.orderBy(draw(seed, column), column)))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    first, second = F.floor(n * train), F.floor(n * val)
    return drawn.withColumn(
        "split", F.when(F.col("__rn") <= first, "train").when(F.col("__rn") <= first + second, "val").otherwise("test")
    ).drop("__rn")


def in_split(examples: DataFrame, assignment: DataFrame, on: str, split: str, order: str, index: str = "split_idx") -> DataFrame:
    """Examples whose class (or id) is in the split, numbered anew from 0 in the original order."""
    return dense_index(examples.join(assignment.filter(F.col("split") == split).select(on), on, "left_semi"), order, index)


def stratified_split(examples: DataFrame, key: str, column: str, train: float, val: float, seed: int) -> DataFrame:
    """Row-level splits within each class: max(1, round(n * ratio)) each, the rest test; val gives way if test is empty.

    Rounding is half to even.  Within a class, rows are counted per hash range first, so that a class that holds most rows
    is not ordered in one task.
    """
    placed = ranked(examples, key, column, seed).withColumn("__n", F.col("__class_n"))
    n, rn = F.col("__n"), F.col("__rn")
    a = F.greatest(F.lit(1.0), F.rint(n * train))
    b0 = F.greatest(F.lit(1.0), F.rint(n * val))
    b = F.when(n - a - b0 < 1, F.greatest(F.lit(0.0), n - a - 1)).otherwise(b0)
    return placed.withColumn("split", F.when(rn <= a, "train").when(rn <= a + b, "val").otherwise("test")).drop("__n", "__rn", "__class_n")


def ranked(rows: DataFrame, key: str, column: str, seed: int, range_rows: int = 1_000_000) -> DataFrame:
    """``__rn``: the row's place (from 1) in its class by drawn order, ``__class_n``: the class's size; in two stages.

    The drawn order is cut by its first digits into so many ranges that even a class with all rows has about ``range_rows`` in
    each; only (class, range) groups are ordered, and range counts give the offsets.
    """
    ranges = min(65536, max(64, -(-rows.count() // range_rows)))
    drawn = rows.withColumn("__draw", draw(seed, key))
    drawn = drawn.withColumn("__range", F.floor(F.conv(F.substring("__draw", 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int"))
    counts = drawn.groupBy(column, "__range").agg(F.count(F.lit(1)).alias("__n"))
    of_class = Window.partitionBy(column)
    before = of_class.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(column).alias("__c"), F.col("__range").alias("__r"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(of_class).alias("__class_n"),
    )
    local = Window.partitionBy(column, "__range").orderBy("__draw", key)
    numbered = drawn.withColumn("__at", F.row_number().over(local))
    placed = numbered.join(offsets, numbered[column].eqNullSafe(offsets["__c"]) & (F.col("__range") == F.col("__r")))
    return placed.withColumn("__rn", F.col("__first") + F.col("__at")).drop("__c", "__r", "__range", "__first", "__at", "__draw")


def verify_split(assignment: DataFrame, key: str, whole: DataFrame) -> DataFrame:
    """Violations: ids in several splits, ids in none, ids that don't exist (kind, n)."""
    twice = assignment.groupBy(key).agg(F.count_distinct("split").alias("k")).filter("k > 1")
    missing = whole.join(assignment, key, "left_anti")
    unknown = assignment.join(whole, key, "left_anti")
    parts = [("overlap", twice), ("missing", missing), ("unknown", unknown)]
    out = None
    for name, part in parts:
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def split_summary(assignment: DataFrame, column: str) -> DataFrame:
    """One row: total, classes, and rows in each split."""
    n = lambda s: F.sum((F.col("split") == s).cast("long")).alias(f"n_{s}")
    return assignment.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(column).alias("classes"), n("train"), n("val"), n("test"))


def nth_smallest(rows: DataFrame, column: str, n: int, few: int = 10_000, total: int | None = None) -> str | None:
    """The n-th smallest (from 1) of a string column of hexadecimal digits; None if there are fewer.

    By counts of beginnings, three digits longer each time, until at most ``few`` strings share one: those are sorted on the driver.
    ``total`` is the number of rows, if it is known.
    """
    if total is not None and n <= total <= few:
        return sorted(r[0] for r in rows.select(column).collect())[n - 1]
    prefix, left = "", n
    while True:
        inside = rows.filter(F.col(column).startswith(prefix)) if prefix else rows
        cut = F.substring(column, 1, len(prefix) + 3).alias("p")
        counts = sorted((r.p, r.n) for r in inside.groupBy(cut).agg(F.count(F.lit(1)).alias("n")).collect())
        for p, size in counts:
            if left <= size:
                break
            left -= size
        else:
            return None
        if size <= few or p == prefix:
            return sorted(r[0] for r in inside.filter(F.col(column).startswith(p)).select(column).limit(max(few, size)).collect())[left - 1]
        prefix = p


def balanced_sample(rows: DataFrame, key: str, column: str, n: int, seed: int) -> DataFrame:
    """Round robin over classes, the order of classes drawn anew each round; all rows if there are no more than n.

    Without an order of all rows: from the classes' sizes follow the last whole round and how many classes are in the next one; the
    last of these by drawn order gives a bound, and rows are kept by their place in their class and that bound.  The driver gets
    the number of classes of each size, at most the root of twice the number of rows.
    """
    sizes = scratch.settle(rows.groupBy(column).agg(F.count(F.lit(1)).alias("__size")), "class-sizes")
    of_size = sorted((r[0], r[1]) for r in sizes.groupBy("__size").agg(F.count(F.lit(1))).collect())
    if sum(size * m for size, m in of_size) <= n:
        return rows
    rounds, left, classes = 0, n, sum(m for _, m in of_size)
    for size, m in of_size:  # rounds up to this size have all classes that are left
        whole = min(size - rounds, left // classes)
        rounds, left = rounds + whole, left - whole * classes
        if rounds < size:
            break
        classes -= m
    placed = ranked(rows, key, column, seed).drop("__class_n")
    keep = F.col("__rn") <= rounds
    if left:
        order = draw(seed, F.lit(rounds + 1), F.col(column))
        last = nth_smallest(sizes.filter(F.col("__size") > rounds).select(order.alias("d")), "d", left, total=classes)
        keep = keep | ((F.col("__rn") == rounds + 1) & (order <= last))
    return placed.filter(keep).drop("__rn")


def proportional_sample(rows: DataFrame, key: str, column: str, n: int | Column, seed: int) -> DataFrame:
    """Largest-remainder allocation of n rows to classes in proportion; ties between remainders by drawn order."""
    classes = rows.groupBy(column).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy()
    n = F.lit(n) if isinstance(n, int) else n
    due = n * F.col("size") / F.sum("size").over(whole)
    c = classes.withColumn("base", F.floor(due)).withColumn("rest", due - F.col("base"))
    order = Window.orderBy(F.desc(F.round("rest", 9)), draw(seed, column))
    c = c.withColumn("given", F.col("base") + (F.row_number().over(order) <= n - F.sum("base").over(whole)).cast("long"))
    c = c.select(F.col(column).alias("__c"), F.least("given", "size").alias("__given"))
    placed = ranked(rows, key, column, seed).drop("__class_n")
    return placed.join(c, placed[column].eqNullSafe(c["__c"])).filter("__rn <= __given").drop("__c", "__given", "__rn")


def learning_curve(rows: DataFrame, key: str, column: str, seed: int, fraction: float | None = None, most: int | None = None) -> DataFrame:
    """A proportional sample of max(1, round(n * fraction)) rows, or of ``most`` rows; one of both is to be given."""
    if (fraction is None) == (most is None):
        raise ValueError("give either a fraction or a number")
    total = rows.count()
    n = min(total, most) if fraction is None else max(1, round(total * fraction))
    return proportional_sample(rows, key, column, n, seed)


def prefix(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by ``order``."""
    return rows.orderBy(order).limit(n)
