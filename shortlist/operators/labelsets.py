"""Hard class sets: the classes most confusable with a query, nested for growing K, and their option letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.prompts import LETTERS
from .sampling import draw


#: Class vectors in one array, and their bytes, at most.
MOST_CLASSES = 5000
MOST_BYTES = 16_000_000
QUERY = ["query_split", "query_idx"]


def similarity_vectors(queries: DataFrame, class_vectors: DataFrame) -> DataFrame:
    """query_split, query_idx, true_class, known (struct class_idx, sim; a block of classes in ascending order) for every query.

    The class table has one row a class (hundreds); up to ``MOST_CLASSES`` and ``MOST_BYTES`` (counted first) it travels as one array, so that
    there is no join of all pairs.  More classes come in blocks of that size: each block's array meets every query.
    """
    n, width = class_vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    blocks = max(1, -(-n // max(1, min(MOST_CLASSES, MOST_BYTES // (8 * max(width or 1, 1))))))
    block = F.pmod(F.xxhash64("class_idx"), F.lit(blocks))
    table = class_vectors.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("class_idx", "vec"))).alias("table"))
    table = F.broadcast(table) if blocks == 1 else table
    q = queries.select(F.col("split").alias("query_split"), F.col("example_idx").alias("query_idx"), F.col("class_idx").alias("true_class"), "vec")
    known = F.transform("table", lambda c: F.struct(c["class_idx"].alias("class_idx"), V.dot(F.col("vec"), c["vec"]).alias("sim")))
    return q.crossJoin(table).select("query_split", "query_idx", "true_class", known.alias("known"))


def class_similarity(queries: DataFrame, class_vectors: DataFrame) -> DataFrame:
    """query_split, query_idx, true_class, class_idx, sim for every query and class."""
    x = similarity_vectors(queries, class_vectors).select("query_split", "query_idx", "true_class", F.explode("known").alias("c"))
    return x.select("query_split", "query_idx", "true_class", "c.class_idx", "c.sim")


def class_ranking(similarity: DataFrame) -> DataFrame:
    """Wrong classes by similarity, rank from 1; ties to the lower class."""
    w = Window.partitionBy("query_split", "query_idx").orderBy(F.desc("sim"), "class_idx")
    return similarity.filter("class_idx <> true_class").withColumn("rank", F.row_number().over(w))


def label_sets(ranking: DataFrame, ks: list[int], n_classes: int, clamp: bool = False) -> DataFrame:
    """query_split, query_idx, true_class, k, classes (ascending): the true class and the k - 1 most similar wrong ones.

    A k beyond the classes there are is an error, or with ``clamp`` a set of all classes.
    """
    if any(k < 2 or (k > n_classes and not clamp) for k in ks):
        raise ValueError(f"k must be between 2 and {n_classes}")
    sizes = F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])).alias("k")
    ranked = ranking.select("query_split", "query_idx", "true_class", "class_idx", "rank", sizes).filter("rank <= k - 1")
    grouped = ranked.groupBy("query_split", "query_idx", "true_class", "k").agg(F.collect_list("class_idx").alias("wrong"))
    return grouped.select("query_split", "query_idx", "true_class", "k", F.array_sort(F.array_append("wrong", F.col("true_class"))).alias("classes"))


def set_similarities(sets: DataFrame, similarity: DataFrame) -> DataFrame:
    """The similarity of each member, aligned to ``classes``."""
    members = sets.select("query_split", "query_idx", "k", "classes", F.explode("classes").alias("class_idx"))
    found = members.join(similarity.select("query_split", "query_idx", "class_idx", "sim"), ["query_split", "query_idx", "class_idx"])
    rows = F.array_sort(F.collect_list(F.struct("class_idx", "sim")))
    return found.groupBy("query_split", "query_idx", "k").agg(rows.alias("r")).select("query_split", "query_idx", "k", F.col("r.class_idx").alias("classes"), F.col("r.sim").alias("sims"))


def options(classes: str | Column, seed: str | Column, query_idx: str = "query_idx", k: str = "k") -> Column:
    """Array of structs (class_idx, letter) of a set's classes in the order of letters, which a hash draws."""
    seed = F.col(seed) if isinstance(seed, str) else seed

    def drawn(c: Column) -> Column:
        return F.struct(F.md5(F.concat_ws(":", seed.cast("string"), F.col(query_idx).cast("string"), F.col(k).cast("string"), c.cast("string"))).alias("h"), c.alias("class_idx"))

    many = F.raise_error(F.lit("more than 52 options")).cast("string")
    letter = lambda i: F.when(i >= len(LETTERS), many).otherwise(F.substring(F.lit(LETTERS), i + 1, F.lit(1)))
    return F.transform(F.array_sort(F.transform(classes, drawn)), lambda x, i: F.struct(x["class_idx"].alias("class_idx"), letter(i).alias("letter")))


def letters(sets: DataFrame, seeds: list[int]) -> DataFrame:
    """One row for each query, k, seed and class: its option letter, drawn by a hash."""
    x = sets.select(*QUERY, "true_class", "k", "classes", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("letter_seed"))
    x = x.select(*QUERY, "true_class", "k", "letter_seed", F.explode(options("classes", "letter_seed")).alias("x"))
    return x.select(*QUERY, "true_class", "k", "letter_seed", "x.class_idx", "x.letter")


def option_map(lettered: DataFrame) -> DataFrame:
    """Letter -> class as a map, and the true class's letter."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "class_idx"))))
    true = F.max(F.when(F.col("class_idx") == F.col("true_class"), F.col("letter")))
    return lettered.groupBy(*QUERY, "k", "letter_seed").agg(pairs.alias("options"), true.alias("true_letter"))


def in_set(gallery: DataFrame, sets: DataFrame) -> DataFrame:
    """query_split, query_idx, k, example_idx: the gallery rows whose class is in the query's set.

    Sets of equal classes are expanded once a set of classes, not once a query, before they meet the gallery.
    """
    alike = sets.select(F.array_sort("classes").alias("classes")).distinct()
    members = alike.select("classes", F.explode("classes").alias("class_idx"))
    rows = gallery.select("class_idx", "example_idx").join(members, "class_idx").select("classes", "example_idx")
    return sets.select(*QUERY, "k", F.array_sort("classes").alias("classes")).join(rows, "classes").select(*QUERY, "k", "example_idx")


def in_set_totals(gallery: DataFrame, sets: DataFrame) -> DataFrame:
    """query_split, query_idx, k, n, first_example, total: what ``in_set`` has for each set, from one row a class instead of one a pair."""
    known = gallery.groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"), F.min("example_idx").alias("first"), F.sum("example_idx").alias("ids"))
    members = sets.select(*QUERY, "k", F.explode("classes").alias("class_idx"))
    # Members are many, but Spark takes them for as small as the sets' files: never to be broadcast.
    return members.hint("merge").join(known, "class_idx").groupBy(*QUERY, "k").agg(F.sum("n").alias("n"), F.min("first").alias("first_example"), F.sum("ids").alias("total"))


def nesting_violations(sets: DataFrame) -> DataFrame:
    """Sets that miss a member of the next smaller set of the same query."""
    w = Window.partitionBy("query_split", "query_idx").orderBy("k")
    return sets.withColumn("smaller", F.lag("classes").over(w)).filter(F.size(F.array_except("smaller", "classes")) > 0)


def classes_to_score(sets: DataFrame) -> DataFrame:
    """All classes in any of the query's sets, ascending: each is scored once."""
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes"))))
    return sets.groupBy("query_split", "query_idx").agg(merged.alias("classes"))


def labels_of(rows: DataFrame, classes: DataFrame, column: str = "class_idx") -> DataFrame:
    """``class_name`` by class number; null for an unknown class."""
    names = classes.select(F.col("class_idx").alias("__c"), "class_name")
    return rows.join(names, rows[column] == names["__c"], "left").drop("__c")
