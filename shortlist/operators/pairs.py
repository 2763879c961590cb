"""Preference pairs within queries, ranking losses over them, and rank correlations.

A query's candidates are gathered into arrays once (one shuffle, on the query's key); pairs never leave a task but as sums, unless
they are asked for.  Counts of pairs and correlations take n log n; losses have a term a pair and go in bounded steps.
``targets`` are compared as stored and the gap is strict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import ranking

KEY = ["query_split", "query_idx"]


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def lists(rows: DataFrame, **columns: Column) -> DataFrame:
    """One row a query with arrays of the given columns, in the order of their values (the first column's first)."""
    each = F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.groupBy(*KEY).agg(each.alias("r")).select(*KEY, *[F.col(f"r.{n}").alias(n) for n in columns])


def flat(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(list of each element, flat columns) of list columns of equal lengths; null numbers are NaN."""
    columns = [batch.column(n) for n in names]
    offsets = np.asarray(columns[0].offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), [c.flatten().to_numpy(zero_copy_only=False) for c in columns]


def sums(listed: DataFrame, names: list[str], out: list[str], f: Callable) -> DataFrame:
    """KEY and the columns ``out`` of each query: ``f`` (list of each element, flat columns, number of lists) gives them as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, columns = flat(batch, names)
            values = [pa.array(np.asarray(v, np.float64)) for v in f(row, columns, batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in KEY], *values], [*KEY, *out])

    kinds = dict(listed.dtypes)
    return listed.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in KEY), *(f"{o} double" for o in out)]))


def preference_pairs(rows: DataFrame, min_gap: float = 0.02, score: str = "score", target: str = "target") -> DataFrame:
    """Pairs i < j of a query's candidates whose targets differ by more than ``min_gap``: both positions, both differences."""
    number = lambda c: F.col(c).cast("double")
    listed = lists(rows, p=F.col("position").cast("long"), s=number(score), t=number(target))
    kinds = dict(listed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, (p, s, t) = flat(batch, ["p", "s", "t"])
            for i, j in ranking.pair_blocks(row, batch.num_rows):
                dt = t[i] - t[j]
                some = (np.abs(dt) > min_gap) & (p[i] < p[j])
                i, j = i[some], j[some]
                keys = [batch.column(k).take(pa.array(row[i])) for k in KEY]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, (p[i], p[j], s[i] - s[j], dt[some]))], [*KEY, "i", "j", "ds", "dt"])

    found = listed.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in KEY), "i long, j long, ds double, dt double"]))
    place = dict(rows.dtypes)["position"]
    return found.withColumns({"i": F.col("i").cast(place), "j": F.col("j").cast(place)})


def _pair_losses(rows: DataFrame, min_gap: float, temperature: float, score: str, target: str, weight_temperature: float | None = None) -> DataFrame:
    """pairs, loss, weight of each query, summed over its pairs; pairs of NULL or NaN targets don't count."""
    listed = lists(rows, s=F.col(score).cast("double"), t=F.col(target).cast("double"))

    def losses(row: np.ndarray, columns: list[np.ndarray], n: int) -> list[np.ndarray]:
        s, t = columns
        r = None
        if weight_temperature is not None:  # softmax of the query's targets
            most = np.full(n, -np.inf)
            np.maximum.at(most, row, t)
            e = np.exp((t - most[row]) / weight_temperature)
            r = e / np.bincount(row, e, minlength=n)[row]
        out = np.zeros((3, n))
        for i, j in ranking.pair_blocks(row, n):
            dt = t[i] - t[j]
            some = np.abs(dt) > min_gap
            i, j, dt = i[some], j[some], dt[some]
            weight = np.ones(len(i)) if r is None else r[i] + r[j]
            loss = weight * ranking.softplus(-np.sign(dt) * (s[i] - s[j]) / temperature)
            out += [np.bincount(row[i], v, minlength=n) for v in (np.ones(len(i)), loss, weight)]
        return list(out)

    return sums(listed, ["s", "t"], ["pairs", "loss", "weight"], losses)


def _mean_loss(q: DataFrame) -> DataFrame:
    n = F.coalesce(F.sum("pairs"), F.lit(0.0)).cast("long").alias("pairs")
    return q.agg(n, F.coalesce(F.try_divide(F.sum("loss"), F.sum("weight")), F.lit(0.0)).alias("loss"))


def pairwise_loss(rows: DataFrame, min_gap: float = 0.02, temperature: float = 1.0, score: str = "score", target: str = "target") -> DataFrame:
    """Mean over pairs of softplus(-sign(dt) ds / T); 0 without pairs."""
    return _mean_loss(_pair_losses(rows, min_gap, temperature, score, target))


def weighted_pairwise_loss(rows: DataFrame, weight_temperature: float, min_gap: float = 0.02, temperature: float = 1.0, score: str = "score", target: str = "target") -> DataFrame:
    """As above with pair weights r_i + r_j, r = softmax of the query's targets / tau; scaled to mean 1."""
    return _mean_loss(_pair_losses(rows, min_gap, temperature, score, target, weight_temperature))


def crossing_loss(rows: DataFrame, temperature: float = 1.0, score: str = "score") -> DataFrame:
    """Right against wrong candidates: mean within each query that has both, then over those queries; 0 without."""
    listed = lists(rows.filter("correct IS NOT NULL"), c=F.col("correct").cast("double"), s=F.col(score).cast("double"))

    def crossing(row: np.ndarray, columns: list[np.ndarray], n: int) -> list[np.ndarray]:
        c, s = columns  # wrong ones come first in a list
        out = np.zeros((2, n))
        for i, j in ranking.pair_blocks(row, n):
            some = c[i] != c[j]
            i, j = i[some], j[some]
            out += [np.bincount(row[i], v, minlength=n) for v in (np.ones(len(i)), ranking.softplus(-(s[j] - s[i]) / temperature))]
        return list(out)

    q = sums(listed, ["c", "s"], ["pairs", "loss"], crossing).filter("pairs > 0")
    return q.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg(F.col("loss") / F.col("pairs")), F.lit(0.0)).alias("loss"))


def combined(first: DataFrame, second: DataFrame, weight: float) -> DataFrame:
    """first loss + weight * second loss (both one row)."""
    return first.select(F.col("loss").alias("a")).crossJoin(second.select(F.col("loss").alias("b"))).select((F.col("a") + weight * F.col("b")).alias("loss"))


def crossing_with_margin_loss(rows: DataFrame, margin_weight: float, temperature: float = 1.0, min_gap: float = 0.02, margin: str = "margin") -> DataFrame:
    return combined(crossing_loss(rows, temperature), pairwise_loss(rows, min_gap, temperature, target=margin), margin_weight)


def pair_counts(rows: DataFrame, min_gap: float = 0.02, score: str = "score", target: str = "target") -> DataFrame:
    """pairs (targets that differ by more than ``min_gap``) and right (those that the scores order alike) of each query, in n log n."""
    listed = lists(rows, s=F.col(score).cast("double"), t=F.col(target).cast("double"))
    return sums(listed, ["s", "t"], ["pairs", "right"], lambda row, c, n: ranking.ordered_pairs(row, c[0], c[1], min_gap, n))


def pairwise_accuracy(rows: DataFrame, min_gap: float = 0.02, **names) -> DataFrame:
    """Share of pairs that the scores order as the targets do; null without pairs."""
    q = pair_counts(rows, min_gap, **names)
    return q.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).cast("long").alias("pairs"), F.try_divide(F.sum("right"), F.sum("pairs")).alias("accuracy"))


def listwise_loss(rows: DataFrame, score: str = "score") -> DataFrame:
    """Mean over queries with a right candidate of log-sum-exp(all) - log-sum-exp(right ones); 0 without."""
    w = Window.partitionBy(*KEY)
    x = rows.withColumn("__e", F.exp(F.col(score) - F.max(score).over(w)))
    q = x.groupBy(*KEY).agg(F.sum("__e").alias("all"), F.sum(F.when(F.col("correct"), F.col("__e"))).alias("right"))
    return q.filter("right IS NOT NULL").agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg(F.log("all") - F.log("right")), F.lit(0.0)).alias("loss"))


def hybrid_listwise_loss(rows: DataFrame, listwise_weight: float = 0.25, min_gap: float = 0.02, temperature: float = 1.0) -> DataFrame:
    return combined(pairwise_loss(rows, min_gap, temperature), listwise_loss(rows), listwise_weight)


def bce_loss(rows: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Binary cross entropy of logits and soft labels; a label outside [0, 1] is an error."""
    s, t = F.col(score), F.col(target)
    t = F.when((t < 0) | (t > 1), F.raise_error(F.lit("a soft label is outside [0, 1]"))).otherwise(t)
    return rows.agg(F.coalesce(F.avg(F.greatest(s, F.lit(0.0)) - s * t + F.log1p(F.exp(-F.abs(s)))), F.lit(0.0)).alias("loss"))


def huber_loss(rows: DataFrame, delta: float = 1.0, score: str = "score", target: str = "target") -> DataFrame:
    d = F.abs(F.col(score) - F.col(target))
    return rows.agg(F.coalesce(F.avg(F.when(d <= delta, d * d / 2).otherwise(delta * (d - delta / 2))), F.lit(0.0)).alias("loss"))


def hybrid_pointwise_loss(rows: DataFrame, pairwise_weight: float = 0.1, min_gap: float = 0.02, temperature: float = 1.0) -> DataFrame:
    return combined(bce_loss(rows), pairwise_loss(rows, min_gap, temperature), pairwise_weight)


@F.pandas_udf(StructType([StructField("spearman", DoubleType()), StructField("kendall", DoubleType())]))
def _rank_correlations(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    n = len(a)
    row = np.repeat(np.arange(n), a.map(len).to_numpy())
    x, y = (np.concatenate([np.zeros(0), *c]).astype(np.float64) for c in (a, b))
    return pd.DataFrame({"spearman": ranking.spearman(row, x, y, n), "kendall": ranking.kendall(row, x, y, n)})


def rank_correlations(rows: str) -> Column:
    """Struct of Spearman's rho (ties by average rank) and Kendall's tau-b of an array of (a, b); null where a or b is constant.

    Both take n log n, so an array may be as long as a row of Spark can hold.
    """
    return _rank_correlations(F.col(f"{rows}.a"), F.col(f"{rows}.b"))


def _paired(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(F.struct(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))).alias("rows"))


def _equal(if_equal: float) -> Column:
    return F.when(F.forall("rows", lambda x: x["a"] == x["b"]), F.lit(if_equal)).otherwise(0.0)


def correlations(rows: DataFrame, a: str, b: str, by: list[str] = KEY, if_equal: float = 1.0) -> DataFrame:
    """spearman, kendall and n of each group; where undefined ``if_equal`` for equal columns, else 0."""
    x = _paired(rows, a, b, by).withColumn("__c", rank_correlations("rows"))
    return x.select(*by, *[F.coalesce(F.nanvl(F.col(f"__c.{c}"), F.lit(None)), _equal(if_equal)).alias(c) for c in ("spearman", "kendall")], F.size("rows").cast("long").alias("n"))


def spearman(rows: DataFrame, a: str, b: str, by: list[str] = KEY, if_equal: float = 1.0) -> DataFrame:
    return correlations(rows, a, b, by, if_equal).select(*by, "spearman", "n")


def kendall(rows: DataFrame, a: str, b: str, by: list[str] = KEY, if_equal: float = 1.0) -> DataFrame:
    return correlations(rows, a, b, by, if_equal).select(*by, "kendall")
