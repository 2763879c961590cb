"""Logistic regression on a bounded sample, on the driver; scores are computed where the data is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most labelled rows a classifier is fitted on.
SAMPLE_ROWS = 20_000


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, standard: bool = True) -> tuple[np.ndarray, float]:
    """Weights and intercept for (soft) labels y in [0, 1], by Newton steps; columns are standardised if asked."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) and standard else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(z.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(z @ w)
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 4 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def first_by_hash(df: DataFrame, rows: int, seed: int, key: str = "doc_id") -> DataFrame:
    """The first ``rows`` rows by a hash of ``key``.

    Rows beyond a bound on the hash that leaves a few more than ``rows`` go before anything is ordered, so that a task is sent
    no more than it needs however many partitions there are.
    """
    n = df.count()
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))
    if n > rows:
        df = df.filter(place < int(min(1.0, (rows + 6 * rows**0.5 + 10) / n) * (1 << 40)))
    return df.orderBy(place, key).limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS, where=None) -> DataFrame:
    """text and label of at most ``rows`` labelled documents, the first by a hash of the id.

    Of several labels of one id the smallest counts, of several texts the one whose md5 is smallest.
    """
    own = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        own = own.filter(where)
    some = own.groupBy("doc_id").agg(F.min(F.col(column).cast("double")).alias("label"))
    some = first_by_hash(some, rows, 17)
    # At most ``rows`` pairs of numbers are sent to the documents.
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.md5("text").alias("m"), "text", "label")).alias("x")).select("doc_id", "x.text", "x.label")
