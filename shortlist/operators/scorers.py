"""Small scorers over (query, candidate) features: linear, a two-layer network, and a fitted pairwise ranker."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions import vectors as V
from ..sources import scratch
from .pairs import KEY, flat, lists


def mean_log_likelihood(tokens: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean token log probability for each key of ``labels``; a label without tokens gets minus infinity."""
    means = tokens.groupBy(*keys).agg(F.avg("logprob").alias("score"))
    return labels.join(means, keys, "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))


def score_vectors(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Scores by class gathered into one vector, by ascending class."""
    rows = F.array_sort(F.collect_list(F.struct("class_idx", "score")))
    return scored.groupBy(*keys).agg(F.transform(rows, lambda r: r["score"]).alias("scores"))


def linear(features: Column, weights: list[float], bias: float = 0.0) -> Column:
    """Dot product with fixed weights."""
    return V.dot(features, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


_erf = np.vectorize(math.erf, otypes=[np.float64])


def two_layer(
    rows: DataFrame, features: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float, out: str = "score",
    scale: np.ndarray | None = None, shift: np.ndarray | None = None,
) -> DataFrame:
    """Layer norm (with its trained ``scale`` and ``shift``), a hidden layer with the exact GELU, and a linear output; weights are broadcast once."""
    sent = rows.sparkSession.sparkContext.broadcast((w1, b1, w2, b2, 1.0 if scale is None else np.asarray(scale), 0.0 if shift is None else np.asarray(shift)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{out} double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w1, b1, w2, b2, scale, shift = sent.value
        for frame in frames:
            x = np.array(frame[features].tolist(), dtype=np.float64).reshape(len(frame), -1)
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * scale + shift
            h = x @ w1 + b1
            h = h * (1 + _erf(h / math.sqrt(2))) / 2 if h.size else h
            yield frame.assign(**{out: h @ w2 + b2})

    return rows.mapInPandas(run, schema)


def fit_pairwise(rows: DataFrame, features: list[str], target: str, min_gap: float = 0.02, ridge: float = 0.01, steps: int = 50, tolerance: float = 1e-9) -> list[float]:
    """Weights of a linear ranker: logistic loss of the feature differences of preference pairs, better candidate less worse one.

    The ridge is on standardised differences.  Newton's method: each step sums the loss, its gradient and its curvature over the
    pairs of every query, from the query's arrays (gathered once); no pair is ever a row, and a step sends the driver
    1 + n + n * n sums for n features.
    """
    names = [f"f{i}" for i in range(len(features))]
    n = len(features)
    columns = {"t": F.col(target).cast("double"), **{a: F.col(c).cast("double") for a, c in zip(names, features)}}
    listed = scratch.settle(lists(rows, **columns), "lists")

    def total(f) -> np.ndarray:
        """Sums over all pairs of what ``f`` gives for differences (pairs x features)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = 0.0
            for batch in batches:
                row, (t, *x) = flat(batch, ["t", *names])
                x = np.stack(x, 1)
                for i, j in ranking.pair_blocks(row, batch.num_rows):
                    dt = t[i] - t[j]
                    some = np.abs(dt) > min_gap
                    out = out + f((x[i[some]] - x[j[some]]) * np.sign(dt[some])[:, None])
            if np.ndim(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["i", "v"])

        sums = listed.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
        return sums.column("v").to_numpy()

    first = total(lambda d: np.r_[len(d), (d * d).sum(0)])
    if not len(first) or not first[0]:
        return [0.0] * n
    pairs = first[0]
    # Each pair counts in both orders, so differences have mean 0 and 2 * pairs - 1 degrees of freedom.
    spread = np.sqrt(2 * first[1:] / (2 * pairs - 1))
    penalty, used = ridge * spread**2, spread > 0

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(d: np.ndarray) -> np.ndarray:
            z = d @ w
            wrong = 1 / (1 + np.exp(np.clip(z, -700, 700)))
            return np.r_[ranking.softplus(-z).sum(), -(d * wrong[:, None]).sum(0), (d.T @ (d * (wrong * (1 - wrong))[:, None])).ravel()]

        v = total(sums) / pairs
        return v[0] + (penalty * w * w).sum() / 2, v[1 : n + 1] + penalty * w, v[n + 1 :].reshape(n, n) + np.diag(penalty + ~used)

    w = np.zeros(n)
    loss, slope, bend = at(w)
    for _ in range(steps):
        step = np.where(used, np.linalg.solve(bend, slope), 0.0)
        part = 1.0
        while True:
            new = at(w - part * step)
            if new[0] <= loss or part < 1e-6:
                break
            part /= 2
        gained, w = loss - new[0], w - part * step
        loss, slope, bend = new
        if np.abs(part * step).max() <= tolerance * (1 + np.abs(w).max()) or gained <= 0:
            break
    return [float(x) for x in w]


def random_position(pool: DataFrame, seed: int) -> DataFrame:
    """A pool member drawn by a hash for each query."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_idx").cast("string"), F.col("example_idx").cast("string")))
    return pool.groupBy(*KEY).agg(F.min_by("position", order).alias("position"))
