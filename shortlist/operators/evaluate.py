"""Evaluation: condition summaries, paired comparisons, selectors, oracles, leaderboards.

Rows come one a query and condition with a struct ``m`` of ``functions.scores.closed_set``; everything here is a grouped
aggregate over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import stats
from ..sources import scratch
from . import pairs, quantiles

CUTOFFS = (1, 5, 10, 20, 50, 100, 200)


def share(test: Column) -> Column:
    """Mean of a condition; null rows are left out."""
    return F.avg(test.cast("double"))


def measure(rows: DataFrame, temperature: float = 1.0, sets: DataFrame | None = None) -> DataFrame:
    """``m`` for rows with scores and true_class; with ``sets`` (query_split, query_idx, k, classes) once for each k."""
    if sets is None:
        return rows.withColumn("m", S.closed_set(F.col("scores"), F.col("true_class"), temperature))
    s = sets.select("query_split", "query_idx", "k", "classes")
    joined = rows.join(s, ["query_split", "query_idx"])
    # The set's scores are a column of their own, so that no metric picks them anew.
    joined = joined.withColumns({"__s": S.restrict(F.col("scores"), F.col("classes")), "__t": S.place_in(F.col("classes"), F.col("true_class"))})
    m = S.closed_set(F.col("__s"), F.col("__t"), temperature)
    return joined.withColumn("m", m.withField("predicted", S.at(F.col("classes"), m["predicted"]))).drop("__s", "__t")


def summarize(measured: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, top-5, macro accuracy (mean over classes), reciprocal and plain ranks, mean probability and shape."""
    m = lambda c: F.col(f"m.{c}")
    macro = measured.groupBy(*by, "true_class").agg(share(m("correct")).alias("a")).groupBy(*by).agg(F.avg("a").alias("macro_accuracy"))
    own = measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(m("correct")).alias("accuracy"), share(m("top5")).alias("top5"),
        F.avg(m("reciprocal_rank")).alias("mrr"), F.avg(m("true_rank")).alias("mean_rank"), F.median(m("true_rank")).alias("median_rank"),
        F.avg(m("probability")).alias("mean_probability"), F.avg(m("margin")).alias("mean_margin"), F.avg(m("gap")).alias("mean_gap"),
        F.avg(m("entropy")).alias("mean_entropy"), F.avg(m("effective_classes")).alias("mean_effective_classes"),
    )
    return own.join(macro, by)


def rank_cdf(measured: DataFrame, by: list[str], n_classes: int) -> DataFrame:
    """Share of true ranks within each cutoff."""
    cuts = sorted({c for c in CUTOFFS if c <= n_classes} | {n_classes})
    return measured.withColumn("cutoff", F.explode(F.array(*map(F.lit, cuts)))).groupBy(*by, "cutoff").agg(share(F.col("m.true_rank") <= F.col("cutoff")).alias("share"))


def paired(measured: DataFrame, treatment: str, control: str, by: list[str] = []) -> DataFrame:
    """Two conditions on the same queries: accuracy difference, discordant counts, mean differences, exact p."""
    keys = ["query_split", "query_idx", *by]

    def side(name: str, alias: str) -> DataFrame:
        return measured.filter(F.col("condition") == name).select(*keys, F.col("m").alias(alias))

    both = side(treatment, "t").join(side(control, "c"), keys)
    a, b = F.col("t.correct"), F.col("c.correct")
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (share(a) - share(b)).alias("difference"),
        F.sum((a & ~b).cast("long")).alias("treatment_only"), F.sum((b & ~a).cast("long")).alias("control_only"),
        F.avg(F.col("t.log_probability") - F.col("c.log_probability")).alias("mean_log_probability_difference"),
        F.avg(F.col("t.margin") - F.col("c.margin")).alias("mean_margin_difference"),
    )
    return out.withColumn("p", stats.mcnemar("treatment_only", "control_only"))


def monotonicity_violations(measured: DataFrame) -> DataFrame:
    """Rows where an answer that was wrong among fewer classes is right among more (nested sets forbid it)."""
    w = Window.partitionBy("query_split", "query_idx", "condition").orderBy("k")
    return measured.withColumn("before", F.lag("m.correct").over(w)).filter(~F.col("before") & F.col("m.correct"))


def copy_breakdown(measured: DataFrame, zero: DataFrame, exemplars: DataFrame) -> DataFrame:
    """By whether the exemplar has the query's class, and in total: accuracies and how often the exemplar's class is named."""
    z = zero.select("query_split", "query_idx", F.col("m").alias("z"))
    e = exemplars.select("query_split", "query_idx", F.col("class_idx").alias("exemplar_class"))
    x = measured.join(z, ["query_split", "query_idx"]).join(e, ["query_split", "query_idx"])
    x = x.withColumn("same_class", F.col("exemplar_class") == F.col("true_class"))
    return x.rollup("same_class").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("z.correct")).alias("zero_accuracy"), share(F.col("m.correct")).alias("accuracy"),
        share(F.col("m.predicted") == F.col("exemplar_class")).alias("copy_rate"),
        share(F.col("z.predicted") == F.col("exemplar_class")).alias("zero_copy_rate"),
    )


def choice_summary(trials: DataFrame) -> DataFrame:
    """Multiple-choice trials (condition, k, letter_seed, true_class, true_letter, pred_letter, correct; nullable).

    One row for all, each seed, each class, each true letter and each predicted letter of a condition and k.
    """
    some = trials.filter("correct IS NOT NULL")
    sets = some.groupingSets(
        [["condition", "k"], *[["condition", "k", c] for c in ("letter_seed", "true_class", "true_letter", "pred_letter")]],
        "condition", "k", "letter_seed", "true_class", "true_letter", "pred_letter",
    )
    return sets.agg(F.count(F.lit(1)).alias("n"), share(F.col("correct")).alias("accuracy"))


def choice_macro(trials: DataFrame) -> DataFrame:
    some = trials.filter("correct IS NOT NULL").groupBy("condition", "k", "true_class").agg(share(F.col("correct")).alias("a"))
    return some.groupBy("condition", "k").agg(F.avg("a").alias("macro_accuracy"))


def clustered_difference(trials: DataFrame, treatment: str, control: str) -> DataFrame:
    """Per k: the mean over queries of the mean difference over seeds, with its standard error and 95 % interval."""
    keys = ["k", "query_split", "query_idx", "letter_seed"]
    t = trials.filter(F.col("condition") == treatment).select(*keys, F.col("correct").alias("t"))
    c = trials.filter(F.col("condition") == control).select(*keys, F.col("correct").alias("c"))
    both = t.join(c, keys).filter("t IS NOT NULL AND c IS NOT NULL")
    d = both.groupBy("k", "query_split", "query_idx").agg(F.avg(F.col("t").cast("double") - F.col("c").cast("double")).alias("d"), F.count(F.lit(1)).alias("trials"))
    out = d.groupBy("k").agg(F.count(F.lit(1)).alias("clusters"), F.sum("trials").alias("trials"), F.avg("d").alias("difference"), (F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return out.withColumns({"low": F.col("difference") - 1.959963984540054 * F.col("se"), "high": F.col("difference") + 1.959963984540054 * F.col("se")})


def seed_transitions(trials: DataFrame, treatment: str, control: str) -> DataFrame:
    """Per k and seed: the four transition counts, the difference and the exact p (permutations aren't independent)."""
    keys = ["k", "query_split", "query_idx", "letter_seed"]
    t = trials.filter(F.col("condition") == treatment).select(*keys, F.col("correct").alias("t"))
    c = trials.filter(F.col("condition") == control).select(*keys, F.col("correct").alias("c"))
    n = lambda test, name: F.sum(test.cast("long")).alias(name)
    a, b = F.col("t"), F.col("c")
    out = t.join(c, keys).groupBy("k", "letter_seed").agg(
        n(a & b, "both"), n(a & ~b, "treatment_only"), n(~a & b, "control_only"), n(~a & ~b, "neither"), (share(a) - share(b)).alias("difference")
    )
    return out.withColumn("p", stats.mcnemar("treatment_only", "control_only"))


def first_trial_rates(trials: DataFrame) -> DataFrame:
    """Query-level rates from each query's first trial per k, with counts of trials, queries and seeds."""
    w = Window.partitionBy("k", "query_split", "query_idx").orderBy("letter_seed")
    x = trials.withColumn("rn", F.row_number().over(w))
    first = x.filter("rn = 1").groupBy("k").agg(
        share(F.col("pool_has_true")).alias("pool_has_true_rate"), share(F.col("top1_in_options")).alias("in_options_rate"), share(F.col("top1_same_class")).alias("same_class_rate")
    )
    counts = trials.groupBy("k").agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("query_split", "query_idx").alias("queries"), F.count_distinct("letter_seed").alias("seeds"))
    return counts.join(first, "k")


def select_best(candidates: DataFrame, score: str, extra: list[str]) -> DataFrame:
    """Each query's candidate of the highest score, the first position if tied."""
    best = F.max_by(F.struct("position", *extra, F.col(score).alias("score")), F.struct(F.col(score), -F.col("position")))
    return candidates.groupBy("query_split", "query_idx").agg(best.alias("x")).select("query_split", "query_idx", "x.*")


def attach_selections(selections: DataFrame, pool: DataFrame, limit: int) -> DataFrame:
    """The chosen exemplar of (query, selector, position), its class, and whether the pool has the true class.

    A position outside the pool is an error.
    """
    facts = pool.filter(F.col("position") < limit).groupBy("query_split", "query_idx").agg(F.bool_or(F.col("class_idx") == F.col("true_class")).alias("pool_has_true"))
    p = pool.filter(F.col("position") < limit).select("query_split", "query_idx", "true_class", "position", "example_idx", "class_idx")
    found = selections.join(p, ["query_split", "query_idx", "position"], "left").join(facts, ["query_split", "query_idx"], "left")
    bad = F.raise_error(F.lit("a selected position is outside the pool"))
    return found.withColumn("example_idx", F.when(F.col("example_idx").isNull(), bad).otherwise(F.col("example_idx")))


def distinct_exemplars(selections: DataFrame) -> DataFrame:
    """Each query's chosen exemplars, once each and ascending: what is to be scored."""
    return selections.groupBy("query_split", "query_idx").agg(F.sort_array(F.collect_set("example_idx")).alias("exemplars"))


def condition_views(selections: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows of each selector (as condition) with the shared score vector of its exemplar."""
    v = scored.select("query_split", "query_idx", "example_idx", "scores").dropDuplicates(["query_split", "query_idx", "example_idx"])
    return selections.withColumnRenamed("selector", "condition").join(v, ["query_split", "query_idx", "example_idx"])


def selector_stats(selections: DataFrame, baseline: str) -> DataFrame:
    """Per selector: same-class rate, agreement with the baseline, mean position, accuracy by whether the pool has the class.

    An empty side is null.
    """
    b = selections.filter(F.col("selector") == baseline).select("query_split", "query_idx", F.col("example_idx").alias("base"))
    x = selections.join(b, ["query_split", "query_idx"])
    has = F.col("pool_has_true")
    return x.groupBy("selector").agg(
        share(F.col("class_idx") == F.col("true_class")).alias("same_class_rate"), share(F.col("example_idx") == F.col("base")).alias("agreement"),
        F.avg("position").alias("mean_position"), share(has).alias("pool_has_true_rate"),
        F.avg(F.when(has, F.col("correct").cast("double"))).alias("accuracy_has"), F.avg(F.when(~has, F.col("correct").cast("double"))).alias("accuracy_lacks"),
    )


def _long(rows: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    names = [c for c in rows.columns if c not in by]
    wide = rows.select(*by, *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in names])
    return wide.unpivot(by, [f"{prefix}{c}" for c in names], "metric", "value")


def held_out_report(scored: DataFrame, sets: DataFrame, selections: DataFrame, control: str, zero_shot: str, samples: int = 2000) -> DataFrame:
    """Long metrics (condition, k, metric, value) of all conditions; k is null over all classes.

    ``scored`` has the score vectors (condition, query_split, query_idx, true_class, scores) of zero-shot and of every selector; each is
    measured over all classes and in the nested ``sets``.  Every selector but ``control`` is compared to it, and it to zero-shot, with
    discordant counts, exact p and bootstrap interval.  Selection statistics and the mean number of distinct exemplars come from
    ``selections`` (with correct).  An answer that gets right as classes are added is an error.
    """
    if control == zero_shot:
        raise ValueError("the control can't be the zero-shot condition")
    both = measure(scored).withColumn("k", F.lit(None).cast("int")).select("condition", *pairs.KEY, "true_class", "k", "m")
    nested = measure(scored, sets=sets).select("condition", *pairs.KEY, "true_class", F.col("k").cast("int").alias("k"), "m")
    w = Window.partitionBy("condition", *pairs.KEY).orderBy(F.asc_nulls_last("k"))
    both = both.unionByName(nested).withColumn("before", F.lag("m.correct").over(w))
    gained = F.coalesce(~F.col("before") & F.col("m.correct"), F.lit(False))
    both = both.withColumn("m", F.when(gained, F.raise_error(F.lit("an answer gets right as classes are added"))).otherwise(F.col("m"))).drop("before")
    summary = _long(summarize(both.withColumn("k", F.coalesce("k", F.lit(0))), ["condition", "k"]), ["condition", "k"])
    base = both.withColumn("control", F.when(F.col("condition") == control, F.lit(zero_shot)).when(F.col("condition") != zero_shot, F.lit(control)))
    keyed = base.withColumn("k", F.coalesce("k", F.lit(0)))
    other = keyed.select(F.col("condition").alias("control"), *pairs.KEY, "k", F.col("m.correct").alias("c"))
    duel = keyed.filter("control IS NOT NULL").join(other, ["control", *pairs.KEY, "k"])
    t, c = F.col("m.correct"), F.col("c")
    counts = duel.groupBy("condition", "k").agg(
        F.count(F.lit(1)).alias("n"), (share(t) - share(c)).alias("difference"), F.sum((t & ~c).cast("long")).alias("treatment_only"), F.sum((c & ~t).cast("long")).alias("control_only")
    )
    tested = counts.withColumn("p", stats.mcnemar("treatment_only", "control_only"))
    interval = stats.bootstrap(counts.select("condition", "k", "n", "treatment_only", "control_only"), ["condition", "k"], samples)
    duels = _long(tested.drop("n"), ["condition", "k"], "paired_").unionByName(_long(interval, ["condition", "k"], "paired_"))
    picked = _long(selector_stats(selections, control).withColumnRenamed("selector", "condition").withColumn("k", F.lit(0)), ["condition", "k"], "selection_")
    each = distinct_exemplars(selections).agg(F.avg(F.size("exemplars")).alias("value")).select(
        F.lit("all").alias("condition"), F.lit(0).alias("k"), F.lit("distinct_exemplars").alias("metric"), "value"
    )
    out = summary.unionByName(duels).unionByName(picked).unionByName(each)
    return out.withColumn("k", F.nullif("k", F.lit(0)))


def oracle_summary(candidates: DataFrame) -> DataFrame:
    """Per k, from candidates (query, k, position, true_class, class_idx, correct, margin, true_rank)."""
    best = F.struct("margin", -F.col("position"))
    q = candidates.groupBy("query_split", "query_idx", "true_class", "k").agg(
        F.bool_or("correct").alias("any"), F.max_by("correct", -F.col("position")).alias("top1"), F.max("margin").alias("margin"),
        F.min("true_rank").alias("rank"), F.max_by(F.col("class_idx") == F.col("true_class"), best).alias("same"),
        F.bool_or(F.col("class_idx") == F.col("true_class")).alias("has"),
    )
    macro = q.groupBy("k", "true_class").agg(share(F.col("any")).alias("a")).groupBy("k").agg(F.avg("a").alias("macro_accuracy"))
    out = q.groupBy("k").agg(
        share(F.col("any")).alias("oracle_accuracy"), share(F.col("top1")).alias("top1_accuracy"), (share(F.col("any")) - share(F.col("top1"))).alias("gain"),
        F.avg("margin").alias("mean_best_margin"), F.avg("rank").alias("mean_best_rank"), share(F.col("same")).alias("best_same_class_rate"), share(F.col("has")).alias("pool_has_true_rate"),
    )
    return out.join(macro, "k")


def first_success(candidates: DataFrame) -> DataFrame:
    """The first exemplar in pool order that leads to a right answer; null if none does."""
    hit = F.min_by(F.when(F.col("correct"), F.col("example_idx")), F.when(F.col("correct"), F.col("position")))
    at = F.min(F.when(F.col("correct"), F.col("position")))
    return candidates.groupBy("query_split", "query_idx").agg(hit.alias("example_idx"), at.alias("position"))


def oracle_curve(candidates: DataFrame, m: int) -> DataFrame:
    """Share of queries solved by the first n candidates, n = 1 .. m: counts of first successes, summed up over m rows."""
    q = candidates.groupBy("query_split", "query_idx").agg(F.min(F.when(F.col("correct"), F.col("position"))).alias("first"))
    total = q.agg(F.count(F.lit(1)).alias("total"))
    hits = q.filter("first IS NOT NULL").groupBy("first").agg(F.count(F.lit(1)).alias("hits"))
    steps = candidates.sparkSession.range(m).select(F.col("id").cast("int").alias("first"))
    curve = steps.join(hits, "first", "left").crossJoin(F.broadcast(total))  # one row on that side
    w = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    return curve.select((F.col("first") + 1).alias("candidates"), (F.sum(F.coalesce("hits", F.lit(0))).over(w) / F.col("total")).alias("accuracy"))


def oracle_by_pool(candidates: DataFrame) -> DataFrame:
    q = candidates.groupBy("query_split", "query_idx").agg(F.bool_or("correct").alias("any"), F.bool_or(F.col("class_idx") == F.col("true_class")).alias("pool_has_true"))
    return q.groupBy("pool_has_true").agg(F.count(F.lit(1)).alias("n"), share(F.col("any")).alias("oracle_accuracy"))


def selection_metrics(candidates: DataFrame, score: str, target: str) -> DataFrame:
    """One row: what picking by ``score`` gains against the first candidate and against the pool's best."""
    pos = -F.col("position")
    q = candidates.groupBy("query_split", "query_idx").agg(
        F.max_by(F.struct("correct", "margin", F.col(target).alias("t"), "position"), F.struct(F.col(score), pos)).alias("s"),
        F.max_by("correct", pos).alias("top1"), F.bool_or("correct").alias("any"), F.max("margin").alias("best_margin"), F.max(target).alias("best_target"),
        F.max_by("position", F.struct("margin", pos)).alias("margin_pick"), F.max_by("position", F.struct(F.col(target), pos)).alias("target_pick"),
        F.max_by("correct", F.struct("margin", pos)).alias("oracle"), F.collect_list(F.struct(F.col(score).alias("a"), F.col("margin").alias("b"))).alias("rows"),
    ).withColumn("rho", pairs.rank_correlations("rows")["spearman"])
    return q.agg(
        F.count(F.lit(1)).alias("queries"), share(F.col("s.correct")).alias("selected_accuracy"), share(F.col("top1")).alias("top1_accuracy"),
        share(F.col("oracle")).alias("pool_oracle_accuracy"), share(F.col("any")).alias("any_correct"), F.avg("s.margin").alias("mean_selected_margin"),
        F.avg(F.col("best_margin") - F.col("s.margin")).alias("mean_margin_regret"), share(F.col("s.position") == F.col("margin_pick")).alias("margin_agreement"),
        share(F.col("s.position") == F.col("target_pick")).alias("target_agreement"), F.avg(F.col("best_target") - F.col("s.t")).alias("mean_target_regret"),
        F.avg(F.coalesce(F.nanvl("rho", F.lit(None)), F.lit(0.0))).alias("mean_margin_spearman"),
    )


def teacher_summary(candidates: DataFrame) -> DataFrame:
    """Per query split, from candidates with structs m (candidate) and z (zero-shot) and the exemplar's class.

    A query is contrastive if some candidate raises its margin and some doesn't.
    """
    pos, gain = -F.col("position"), F.col("m.margin") - F.col("z.margin")
    q = candidates.groupBy("query_split", "query_idx").agg(
        F.first("z.correct").alias("zero"), F.max_by("m.correct", pos).alias("top1"), F.bool_or("m.correct").alias("any"),
        F.max_by("position", F.struct("m.margin", pos)).alias("oracle"), F.bool_or(gain > 0).alias("up"), F.bool_or(gain <= 0).alias("down"),
    )
    per_query = q.groupBy("query_split").agg(
        F.count(F.lit(1)).alias("queries"), share(F.col("zero")).alias("zero_accuracy"), share(F.col("top1")).alias("top1_accuracy"),
        share(F.col("any")).alias("any_correct"), share(F.col("oracle") == 0).alias("oracle_at_top1"), share(F.col("up") & F.col("down")).alias("contrastive_rate"),
    )
    per_pair = candidates.groupBy("query_split").agg(
        F.count(F.lit(1)).alias("pairs"), share(F.col("m.correct")).alias("pair_accuracy"), share(F.col("class_idx") == F.col("true_class")).alias("same_class_rate"),
        share(gain > 0).alias("positive_increment_rate"),
    )
    return per_query.join(per_pair, "query_split")


def teacher_distributions(candidates: DataFrame) -> DataFrame:
    """The five distributions of a teacher artifact, by query split: margins and true probabilities, with their increments."""
    m, z = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"z.{c}"))
    return distribution(candidates, "query_split", {
        "margin": m("margin"), "incremental_margin": m("margin") - z("margin"), "true_probability": m("probability"),
        "incremental_true_probability": m("probability") - z("probability"), "incremental_true_log_probability": m("log_probability") - z("log_probability"),
    })


def scoring_counts(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n): how many query records were scored in which mode, batch size, ..."""
    return records.select(*[F.col(c).cast("string").alias(c) for c in fields]).unpivot([], fields, "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def distribution(rows: DataFrame, by: str, columns: dict[str, Column]) -> DataFrame:
    """Seven numbers of each column: mean, population deviation, min, p05, median, p95, max (interpolated)."""
    x = scratch.settle(rows.select(by, *[c.alias(n) for n, c in columns.items()]).unpivot(by, list(columns), "column", "value"), "values")
    sums = x.groupBy(by, "column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles.quantiles(x, [by, "column"], "value", [0.05, 0.5, 0.95]).select(F.col(by).alias("b"), F.col("column").alias("c"), "q")
    out = sums.join(q, F.col(by).eqNullSafe(F.col("b")) & (F.col("column") == F.col("c")), "left")
    return out.select(by, "column", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p05", "p50", "p95"))], "max")


def candidate_ranks(candidates: DataFrame, score: str) -> DataFrame:
    """Rank from 0 of each candidate by score, stable; missing candidates are simply not there."""
    w = Window.partitionBy("query_split", "query_idx").orderBy(F.desc(score), "position")
    return candidates.withColumn("rank", F.row_number().over(w) - 1)


def compare_selectors(selections: DataFrame, a: str, b: str) -> DataFrame:
    """Same-pick rate, either-correct rate, and each one's accuracy."""
    s = lambda n, x: selections.filter(F.col("selector") == n).select("query_split", "query_idx", F.col("example_idx").alias(f"e_{x}"), F.col("correct").alias(f"c_{x}"))
    return s(a, "a").join(s(b, "b"), ["query_split", "query_idx"]).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("e_a") == F.col("e_b")).alias("same_pick_rate"), share(F.col("c_a") | F.col("c_b")).alias("either_correct"),
        share(F.col("c_a")).alias("accuracy_a"), share(F.col("c_b")).alias("accuracy_b"),
    )


def label_match(pool: DataFrame, similarity: DataFrame) -> DataFrame:
    """The candidate whose class is most similar to the query; the first position if tied."""
    s = similarity.select("query_split", "query_idx", "class_idx", "sim")
    return select_best(pool.join(s, ["query_split", "query_idx", "class_idx"]), "sim", ["example_idx", "class_idx"])


def selector_breakdown(selections: DataFrame, top1: str) -> DataFrame:
    """Accuracy by whether the pick and the first exemplar have the query's class."""
    t = selections.filter(F.col("selector") == top1).select("query_split", "query_idx", (F.col("class_idx") == F.col("true_class")).alias("top1_same_class"))
    x = selections.join(t, ["query_split", "query_idx"]).withColumn("pick_same_class", F.col("class_idx") == F.col("true_class"))
    return x.groupBy("selector", "pick_same_class", "top1_same_class").agg(F.count(F.lit(1)).alias("n"), share(F.col("correct")).alias("accuracy"))


def position_buckets(selections: DataFrame, edges: list[int]) -> DataFrame:
    """Share of each selector's picks in position ranges [0, e1), [e1, e2), ..."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("position") >= e).cast("int")
    n = selections.groupBy("selector", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("selector")))


def best_epochs(history: DataFrame, patience: int, tolerance: float = 1e-12, primary_mode: str = "max", secondary_mode: str = "max") -> DataFrame:
    """Per run, in order of its epochs: the best one, where patience ends training, and the last one seen.

    An epoch improves if its primary metric is better than the best one's, or within ``tolerance`` of it and its secondary metric is
    better than the best one's; the improving epoch is the best one from then on.  Better is greater, or smaller for a metric whose
    mode is ``min``.  A run's epochs are one array.
    """
    if {primary_mode, secondary_mode} - {"min", "max"}:
        raise ValueError("a mode is min or max")
    good = lambda c, mode: F.col(c) if mode == "max" else -F.col(c)
    epochs = F.array_sort(F.collect_list(F.struct("epoch", good("primary_metric", primary_mode).alias("p"), good("secondary_metric", secondary_mode).alias("s"))))
    none = F.lit(None)
    start = F.struct(
        F.lit(float("-inf")).alias("p"), F.lit(float("-inf")).alias("s"), none.cast("long").alias("best"), none.cast("long").alias("last"),
        F.lit(0).cast("long").alias("since"), none.cast("long").alias("stop"),
    )

    def step(a: Column, e: Column) -> Column:
        better = (e["p"] > a["p"]) | ((F.abs(e["p"] - a["p"]) <= tolerance) & (e["s"] > a["s"]))
        since = F.when(better, F.lit(0).cast("long")).otherwise(a["since"] + 1)
        new = F.struct(
            F.when(better, e["p"]).otherwise(a["p"]).alias("p"), F.when(better, e["s"]).otherwise(a["s"]).alias("s"),
            F.when(better, e["epoch"].cast("long")).otherwise(a["best"]).alias("best"), e["epoch"].cast("long").alias("last"), since.alias("since"),
            F.when((since >= patience) & a["best"].isNotNull(), e["epoch"].cast("long")).alias("stop"),
        )
        return F.when(a["stop"].isNotNull(), a).otherwise(new)

    x = history.groupBy("run_id").agg(F.aggregate(epochs, start, step).alias("x"))
    kind = dict(history.dtypes)["epoch"]
    return x.select("run_id", *[F.col(f"x.{c}").cast(kind).alias(n) for c, n in (("best", "best_epoch"), ("stop", "stop_epoch"), ("last", "last_epoch"))])


def leaderboard(history: DataFrame, primary_mode: str = "max", secondary_mode: str = "max") -> DataFrame:
    """One best row a run, in order of (primary, secondary)."""
    sign = lambda c, mode: F.col(c) if mode == "max" else -F.col(c)
    order = F.struct(sign("primary_metric", primary_mode), sign("secondary_metric", secondary_mode), -F.col("epoch"))
    best = history.groupBy("run_id").agg(F.max_by(F.struct("epoch", "primary_metric", "secondary_metric"), order).alias("x")).select("run_id", "x.*")
    return best.orderBy(F.desc(sign("primary_metric", primary_mode)), F.desc(sign("secondary_metric", secondary_mode)), "run_id")


def grid(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Least, greatest and mean metric in every cell of the swept keys and all their margins."""
    return rows.cube(*keys).agg(F.count(F.lit(1)).alias("runs"), F.min(metric).alias("least"), F.max(metric).alias("most"), F.avg(metric).alias("mean"))
