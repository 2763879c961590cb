"""Column builders for score vectors (array<double>, one score a class): metrics, restricted sets, training targets.

All are row-wise, so they never shuffle.  Ties go to the lower class everywhere: the predicted class is the first of the
largest scores, and a class's rank counts larger scores and equal scores before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let, total


def at(scores: Column, i: Column) -> Column:
    """The element at 0-based place i (null outside)."""
    return F.get(scores, i.cast("int"))


def predicted(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def rank(scores: Column, true: Column) -> Column:
    """1 for the first of the largest; the place of the first equal score in descending order, plus equal ones before."""
    own = at(scores, true)
    before = F.slice(scores, F.lit(1), true)
    return (F.array_position(F.sort_array(scores, asc=False), own) + F.size(before) - F.size(F.array_remove(before, own))).cast("int")


def best_other(scores: Column, true: Column) -> Column:
    """The best score of the other classes; null if there is none."""
    ordered, own = F.sort_array(scores, asc=False), at(scores, true)
    return F.when(own < F.get(ordered, F.lit(0)), F.get(ordered, F.lit(0))).otherwise(F.get(ordered, F.lit(1)))


def strongest_other(scores: Column, true: Column) -> Column:
    """The first class of the best other score."""
    best = best_other(scores, true)
    first = F.array_position(scores, best) - 1
    behind = F.slice(scores, true + 2, F.size(scores))
    return F.when(first != true, first).otherwise(true + F.array_position(behind, best)).cast("int")


def margin(scores: Column, true: Column) -> Column:
    """True score less the best other; infinite if there is no other class."""
    return F.coalesce(at(scores, true) - best_other(scores, true), F.lit(float("inf")))


def gap(scores: Column) -> Column:
    ordered = F.sort_array(scores, asc=False)
    return F.coalesce(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)), F.lit(float("inf")))


def log_total(scores: Column, temperature: float = 1.0) -> Column:
    """Logarithm of the sum of exponentials, shifted by the maximum."""
    return let(F.array_max(scores) / temperature, lambda most: most + F.log(F.aggregate(scores, F.lit(0.0), lambda n, s: n + F.exp(s / temperature - most))))


def log_probability(scores: Column, true: Column, temperature: float = 1.0) -> Column:
    return at(scores, true) / temperature - log_total(scores, temperature)


def entropy(scores: Column, temperature: float = 1.0) -> Column:
    """Of the softmax; classes whose probability underflows add nothing."""
    def of(log_sum: Column) -> Column:
        logs = F.transform(scores, lambda s: s / temperature - log_sum)
        return total(F.transform(logs, lambda p: F.when(F.exp(p) > 0, -F.exp(p) * p).otherwise(0.0)))

    return let(log_total(scores, temperature), of)


def closed_set(scores: Column, true: Column, temperature: float = 1.0) -> Column:
    """All metrics of one vector as a struct; the temperature changes probabilities and entropy only."""
    r, h = rank(scores, true), entropy(scores, temperature)
    logp = log_probability(scores, true, temperature)
    return F.struct(
        predicted(scores).alias("predicted"),
        (predicted(scores) == true).alias("correct"),
        (r <= 5).alias("top5"),
        r.alias("true_rank"),
        (1.0 / r).alias("reciprocal_rank"),
        at(scores, true).alias("true_score"),
        logp.alias("log_probability"),
        F.exp(logp).alias("probability"),
        margin(scores, true).alias("margin"),
        gap(scores).alias("gap"),
        h.alias("entropy"),
        F.exp(h).alias("effective_classes"),
    )


def restrict(scores: Column, classes: Column) -> Column:
    """The scores of the (ascending) classes of a set."""
    return F.transform(classes, lambda c: at(scores, c))


def place_in(classes: Column, c: Column) -> Column:
    return (F.array_position(classes, c) - 1).cast("int")


def restricted(scores: Column, classes: Column, true: Column, temperature: float = 1.0) -> Column:
    """``closed_set`` over a set of classes, the predicted class given by its global number."""
    m = closed_set(restrict(scores, classes), place_in(classes, true), temperature)
    return m.withField("predicted", at(classes, m["predicted"]))


def teacher(scores: Column, true: Column, temperature: float = 1.0) -> Column:
    """Metrics that the training targets use; needs two classes at least."""
    logp = log_probability(scores, true, temperature)
    return F.struct(
        (predicted(scores) == true).alias("correct"),
        rank(scores, true).alias("true_rank"),
        at(scores, true).alias("true_score"),
        strongest_other(scores, true).alias("strongest_wrong"),
        best_other(scores, true).alias("strongest_wrong_score"),
        (at(scores, true) - best_other(scores, true)).alias("margin"),
        logp.alias("log_probability"),
        F.exp(logp).alias("probability"),
    )


def output_class(scores: Column, classes: Column) -> Column:
    """The class that the scores (aligned to ``classes``) name."""
    return F.element_at(classes, F.array_position(scores, F.array_max(scores)).cast("int"))


def sigmoid(x: Column, limit: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def normalised_increment(new: Column, old: Column, power: float) -> Column:
    most = F.greatest(F.pow(F.greatest(new, old), F.lit(power)), F.lit(1e-12))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((new - old) / most + 1) / 2))


#: Targets by name (the names are fixed values), from a struct ``m`` of candidate metrics and ``z`` of zero-shot metrics.
RAW_TARGETS = {
    "margin": lambda m, z: m["margin"],
    "true_log_probability": lambda m, z: m["log_probability"],
    "true_probability": lambda m, z: m["probability"],
    "incremental_margin": lambda m, z: m["margin"] - z["margin"],
    "incremental_true_log_probability": lambda m, z: m["log_probability"] - z["log_probability"],
    "incremental_true_probability": lambda m, z: m["probability"] - z["probability"],
}
BOUNDED_TARGETS = (
    "bounded_margin",
    "bounded_incremental_margin",
    "mean_token_probability",
    "normalized_incremental_mean_token_probability",
    "normalized_incremental_probability",
)
TARGETS = (*RAW_TARGETS, *BOUNDED_TARGETS)


def likelihood(score: Column) -> Column:
    """Probability of a mean log likelihood; one above 0 (but for rounding) is an error."""
    bad = F.raise_error(F.lit("a mean token log probability is above 0"))
    return F.when(score > 1e-5, bad).otherwise(F.exp(F.greatest(F.lit(-80.0), F.least(F.lit(0.0), score))))


def target(kind: str, m: Column, z: Column, temperature: float = 1.0, power: float = 0.5) -> Column:
    """A training target by name; the token kinds need scores that are mean log likelihoods."""
    if temperature <= 0 or not 0 <= power <= 1:
        raise ValueError("the temperature must be positive, the power between 0 and 1")
    if kind in RAW_TARGETS:
        return RAW_TARGETS[kind](m, z)
    if kind == "bounded_margin":
        return sigmoid(m["margin"] / temperature)
    if kind == "bounded_incremental_margin":
        return sigmoid((m["margin"] - z["margin"]) / temperature)
    if kind == "mean_token_probability":
        return likelihood(m["true_score"])
    if kind == "normalized_incremental_mean_token_probability":
        return normalised_increment(likelihood(m["true_score"]), likelihood(z["true_score"]), power)
    if kind == "normalized_incremental_probability":
        return normalised_increment(m["probability"], z["probability"], power)
    raise ValueError(f"no target {kind}")
