"""Label-space audit: how well scores over a query's K-set stand for scores over all classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import scratch
from . import quantiles
from .evaluate import share
from .pairs import KEY, correlations


def audit_rows(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """(query, k, position) with full and restricted margins, correctness over all classes, strongest-wrong coverage."""
    # Metrics over all classes once a candidate, before it meets the sets.
    x = candidates.withColumn("f", S.teacher(F.col("scores"), F.col("true_class"))).join(sets.select(*KEY, "k", "classes"), KEY)
    x = x.withColumns({"__s": S.restrict(F.col("scores"), F.col("classes")), "__t": S.place_in(F.col("classes"), F.col("true_class"))})
    x = x.withColumn("r", S.teacher(F.col("__s"), F.col("__t")))
    return x.select(
        *KEY, "k", "position", F.col("f.margin").alias("full_margin"), F.col("r.margin").alias("margin"), F.col("f.correct").alias("full_correct"),
        F.expr("array_contains(classes, f.strongest_wrong)").alias("covered"),
    )


def audit_summary(rows: DataFrame) -> DataFrame:
    """Per k: coverage, mean rank correlations, agreement on the best exemplar, accuracy and regret of the restricted choice."""
    by = [*KEY, "k"]
    pos = -F.col("position")
    q = rows.groupBy(*by).agg(
        F.max_by(F.struct("position", "full_correct", "full_margin"), F.struct("margin", pos)).alias("s"),
        F.max_by(F.struct("position", "full_correct", "full_margin"), F.struct("full_margin", pos)).alias("o"),
        F.avg(F.col("covered").cast("double")).alias("coverage"),
    )
    c = correlations(rows, "margin", "full_margin", by).drop("n")
    x = scratch.settle(q.join(c, by).withColumn("regret", F.col("o.full_margin") - F.col("s.full_margin")), "audited")
    sums = x.groupBy("k").agg(
        F.avg("coverage").alias("coverage"), F.avg("spearman").alias("mean_spearman"), F.avg("kendall").alias("mean_kendall"),
        share(F.col("s.position") == F.col("o.position")).alias("top_agreement"), share(F.col("s.full_correct")).alias("selected_accuracy"),
        share(F.col("o.full_correct")).alias("oracle_accuracy"), (share(F.col("o.full_correct")) - share(F.col("s.full_correct"))).alias("accuracy_gap"),
        F.avg("regret").alias("mean_regret"),
    )
    q = quantiles.quantiles(x, ["k"], "regret", [0.5, 0.95]).select("k", F.get("q", F.lit(0)).alias("median_regret"), F.get("q", F.lit(1)).alias("p95_regret"))
    return sums.join(q, "k", "left")
