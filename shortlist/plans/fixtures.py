"""Tables of the domain, derived from ``embeddings`` by plain queries (the same in any engine).

Scores are a stand-in for a model's output: a deterministic function of the vectors, never above 0.  The library takes any
table of scores.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vectors as V
from ..operators import labelsets, retrieval
from ..sources import scratch

POOL = 30
KS = [2, 4, 6, 8, 10]
N_CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("vec_id") % 10 == 0, "test").when(F.col("vec_id") % 10 == 1, "val").otherwise("train")
    return e.select(F.col("vec_id").alias("example_idx"), F.col("label").alias("class_idx"), split.alias("split"), F.col("embedding").cast("array<double>").alias("vec"))


def class_vectors(ex: DataFrame) -> DataFrame:
    """Unit mean vector of each class over the train split."""
    parts = ex.filter("split = 'train'").select("class_idx", F.posexplode("vec").alias("i", "x"))
    means = parts.groupBy("class_idx", "i").agg(F.avg("x").alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"])
    return means.groupBy("class_idx").agg(vec.alias("v")).select("class_idx", V.normalise(F.col("v")).alias("vec"))


def zero_scores(sims: DataFrame) -> DataFrame:
    return sims.select("query_split", "query_idx", "true_class", F.transform("sims", lambda s: s - 3).alias("scores"))


def pair_scores(pool: DataFrame, sims: DataFrame) -> DataFrame:
    """Pool rows with the score vector of (query, exemplar)."""
    q = sims.select("query_split", "query_idx", F.col("sims").alias("qs"))
    e = sims.filter("query_split = 'train'").select(F.col("query_idx").alias("example_idx"), F.col("sims").alias("es"))
    x = pool.join(q, ["query_split", "query_idx"]).join(e, "example_idx")
    own = F.transform(F.zip_with("qs", "es", lambda a, b: a + 0.5 * b), lambda s, c: s + F.when(c == F.col("class_idx"), 0.3 * F.col("similarity")).otherwise(0.0) - 3)
    return x.withColumn("scores", own).drop("qs", "es")


def sets(sim: DataFrame, ks: list[int] = KS, clamp: bool = False) -> DataFrame:
    return labelsets.label_sets(labelsets.class_ranking(sim), ks, N_CLASSES, clamp)


class World:
    """The fixture's tables.  Pools, class similarities, pair scores and candidates are written once, when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, splits: list[str] = ["test", "val", "train"]):
        self.spark, self.sf_dir, self.splits = spark, sf_dir, splits
        self.ex = examples(spark, sf_dir)
        self.queries = self.ex.filter(F.col("split").isin(splits))
        self.gallery = self.ex.filter("split = 'train'")

    @cached_property
    def cv(self) -> DataFrame:
        return scratch.settle(class_vectors(self.ex), "class-vectors")

    @cached_property
    def sims(self) -> DataFrame:
        """query_split, query_idx, true_class, sims: similarities to all classes, by class (one block of classes)."""
        known = labelsets.similarity_vectors(self.ex, self.cv)
        return scratch.settle(known.select("query_split", "query_idx", "true_class", F.transform("known", lambda c: c["sim"]).alias("sims")), "similarities")

    @property
    def sim(self) -> DataFrame:
        return self.sims.select("query_split", "query_idx", "true_class", F.posexplode("sims").alias("class_idx", "sim"))

    @cached_property
    def pool(self) -> DataFrame:
        return scratch.settle(retrieval.top_m(self.queries, self.gallery, POOL), "pool")

    @cached_property
    def first(self) -> DataFrame:
        """The first of each pool; pools aren't searched for it."""
        if "pool" in self.__dict__:
            return self.pool.filter("position = 0")
        return scratch.settle(retrieval.top_m(self.queries, self.gallery, 1), "first")

    @property
    def own(self) -> DataFrame:
        return self.sims.filter(F.col("query_split").isin(self.splits))

    @property
    def zero(self) -> DataFrame:
        return zero_scores(self.own)

    @cached_property
    def pair(self) -> DataFrame:
        return scratch.settle(pair_scores(self.pool, self.sims), "pair")

    @cached_property
    def sets(self) -> DataFrame:
        return scratch.settle(sets(self.sim.filter(F.col("query_split").isin(self.splits))), "sets")

    @property
    def conditions(self) -> DataFrame:
        """Zero-shot and first-exemplar score vectors, by condition."""
        z = self.zero.select("query_split", "query_idx", "true_class", F.lit("zero_shot").alias("condition"), "scores")
        t = pair_scores(self.first, self.sims).select("query_split", "query_idx", "true_class", F.lit("top1").alias("condition"), "scores")
        return z.unionByName(t)

    @cached_property
    def cand(self) -> DataFrame:
        """Pool rows with scores, ``m`` and ``z`` (metrics with and without the exemplar) and a selector ``score``."""
        key = ["query_split", "query_idx"]
        z = self.zero.select(*key, S.teacher(F.col("scores"), F.col("true_class")).alias("z"))
        s = self.sims.select(*key, "sims")
        x = pair_scores(self.pool, self.sims).join(z, key).join(s, key).withColumn("m", S.teacher(F.col("scores"), F.col("true_class")))
        x = x.withColumn("score", S.at(F.col("sims"), F.col("class_idx")) + 0.5 * F.col("similarity")).drop("sims")
        x = x.withColumns({"correct": F.col("m.correct"), "margin": F.col("m.margin"), "true_rank": F.col("m.true_rank"), "target": S.sigmoid(F.col("m.margin") * 4)})
        return scratch.settle(x, "candidates")

    @cached_property
    def ranked(self) -> DataFrame:
        """What losses need of ``cand``: the selector's score, the target and the outcome, without vectors and metrics."""
        x = pair_scores(self.pool, self.sims).join(self.sims.select("query_split", "query_idx", "sims"), ["query_split", "query_idx"])
        score = S.at(F.col("sims"), F.col("class_idx")) + 0.5 * F.col("similarity")
        x = x.select("query_split", "query_idx", "position", score.alias("score"), S.teacher(F.col("scores"), F.col("true_class")).alias("m"))
        x = x.select("query_split", "query_idx", "position", "score", "m.correct", "m.margin", S.sigmoid(F.col("m.margin") * 4).alias("target"))
        return scratch.settle(x, "ranked")

    @cached_property
    def picked(self) -> DataFrame:
        return scratch.settle(self.selections(), "selections")

    def selections(self, limit: int = POOL) -> DataFrame:
        """What four selectors pick: the first, the scorer's, the label match, a hash-random one; with correctness."""
        from ..operators import evaluate, scorers

        c = self.cand
        first = c.filter("position = 0").select("query_split", "query_idx", "position", F.lit("top1").alias("selector"))
        best = evaluate.select_best(c, "score", []).select("query_split", "query_idx", "position", F.lit("scorer").alias("selector"))
        match = evaluate.label_match(self.pool, self.sim).select("query_split", "query_idx", "position", F.lit("label_match").alias("selector"))
        drawn = scorers.random_position(self.pool, 5).select("query_split", "query_idx", "position", F.lit("random").alias("selector"))
        picks = first.unionByName(best).unionByName(match).unionByName(drawn)
        found = evaluate.attach_selections(picks, self.pool, limit)
        right = c.select("query_split", "query_idx", "position", "correct", "scores")
        return found.join(right, ["query_split", "query_idx", "position"])
