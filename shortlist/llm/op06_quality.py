"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence is a logistic regression on word and byte statistics, fitted on at most ``SAMPLE_ROWS`` labelled
rows.  Its log odds are moved by those of its place: the mean quality of a path (host and language) is shrunk towards that
of its host, and the host's towards the whole; the strengths of both priors are estimated from the spread between hosts and
between paths (moments of grouped sums).  A sparse site hence tells nothing, a large one what it is.  The document itself is
left out of its path's mean.

Scale: one scan of the texts writes each row's evidence (with what is carried); the only shuffle has one partial sum a path and
task.  The table of paths is broadcast below
``BROADCAST_PATHS`` rows, else joined by a shuffle.

Nulls and odd input: null and wordless texts are rejected; a null source or language is a place of its own; without labels
of both kinds every text with words is kept (score = prior); further columns are kept; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import linear

BROADCAST_PATHS = 100_000
REJECT_BELOW = 0.5
FEATURES = 12

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = ~(C.ALPHANUMERIC | ~C.NOT_SPACE)
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of statistics and the number of words for each text."""
    starts, ends, rows = C.words_of(data, offsets, C.NOT_SPACE)
    n = np.diff(rows)
    words, size = C.word_hashes(data, starts, ends), ends - starts
    upper, lower = _sums(_UPPER[data], starts, ends), _sums(_LOWER[data], starts, ends)
    symbols, odd = _sums(_SYMBOL[data], starts, ends), _sums((_SYMBOL & ~_PLAIN)[data], starts, ends)
    digits = _sums(_DIGIT[data], starts, ends)

    def mean(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values, dtype=np.float64)]
        return (total[rows[1:]] - total[rows[:-1]]) / np.maximum(n, 1)

    row = np.repeat(np.arange(len(n)), n)

    def new(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, own))
        h, o = hashes[order], own[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])][: len(h)]
        return np.bincount(o[first], minlength=len(n))

    pairs = C.mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    inside = row[:-1] == row[1:] if len(words) > 1 else np.zeros(0, bool)
    repeat = np.zeros(len(words))
    if len(words) > 1:
        repeat[1:] = inside & (words[1:] == words[:-1])
    length = np.log1p(n)
    x = np.c_[
        length, mean((upper > 0) & (lower == 0) & (size > 2)), mean((odd >= 2) | (symbols >= 3)), mean(odd / np.maximum(size, 1)),
        mean(digits / np.maximum(size, 1)), 1 - new(words, row) / np.maximum(n, 1),
        1 - new(pairs[inside], row[:-1][inside] if len(words) > 1 else row) / np.maximum(n - 1, 1), mean(repeat), mean(symbols == size),
        np.minimum(mean(size), 40), mean(symbols > 0), mean(upper > lower + 1),
    ]
    return x, n


def _matrix(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a (bounded) sample."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in C.utf8_blocks(batch.column("text")):
                x, n = features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [C.lists(x.ravel(), np.full(len(n), FEATURES), pa.float64()), batch.column("label")[first:end]], ["x", "label"]
                )

    rows = sample.select("text", "label").mapInArrow(measure, "x array<double>, label double").collect()
    return np.array([r.x for r in rows]).reshape(len(rows), FEATURES), np.array([r.label for r in rows])


def _measured(docs: DataFrame, carry: list[str], weights: np.ndarray, intercept: float) -> DataFrame:
    """``carry``, __words and __logit of every row."""
    schema = docs.select(*carry).schema
    full = T.StructType([*schema, T.StructField("__words", T.LongType()), T.StructField("__logit", T.DoubleType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(data, offsets) for _, _, data, offsets in C.utf8_blocks(batch.column("__text"))]
            n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            logit = np.concatenate([p[0] @ weights + intercept for p in parts]) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array(n), pa.array(np.clip(logit, -30, 30))], [*carry, "__words", "__logit"]
            )

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(measure, full)


def _strength(groups: DataFrame, mean: str, default: float = 10.0) -> float:
    """Prior strength (pseudo rows) from the spread of the groups' means around ``mean``, by moments; s and n are sums."""
    r = groups.filter("n > 1").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2).alias("between"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("binomial"),
    ).first()
    if not r.n or r.k < 2:
        return default
    noise = r.binomial / r.n
    extra = (r.between - r.k * noise) / r.n
    return float(min(1e6, max(1.0, noise / extra - 1))) if extra > 0 else 1e6


def judge(docs: DataFrame, labels: DataFrame, carry: list[str], host: str = "source", path: str = "lang", rows: int = linear.SAMPLE_ROWS) -> DataFrame:
    """``carry`` columns of every row with __evidence, __place and __score (all probabilities of good quality)."""
    x, y = _matrix(linear.labelled(docs, labels, "quality", rows))
    fitted = len(set(y)) > 1
    weights, intercept = linear.fit(x, y) if fitted else (np.zeros(FEATURES), 2.0)
    need = list(dict.fromkeys([*carry, host, path]))
    # Written once with what is carried, so that no text is measured twice.
    measured = C.settle(_measured(docs, need, weights, intercept), "evidence").withColumn("__p", 1 / (1 + F.exp(-F.col("__logit"))))
    paths = C.settle(measured.groupBy(F.col(host).alias("h"), F.col(path).alias("p")).agg(F.sum("__p").alias("s"), F.count(F.lit(1)).alias("n")), "paths")
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    mu = min(max((whole.s or 0) / whole.n if whole.n else 0.5, 0.01), 0.99)
    hosts = paths.groupBy("h").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("mu", F.lit(mu))
    strong = _strength(hosts, "mu")
    host_mean = hosts.select(F.col("h").alias("hh"), ((F.col("s") + strong * mu) / (F.col("n") + strong)).alias("host_mean"))
    near = paths.join(host_mean, F.col("h").eqNullSafe(F.col("hh"))).drop("hh")
    narrow = _strength(near, "host_mean")
    side = near.select(F.col("h").alias("__h"), F.col("p").alias("__pp"), F.col("s").alias("__s"), F.col("n").alias("__n"), F.col("host_mean").alias("__m"))
    if whole.k <= BROADCAST_PATHS:
        side = F.broadcast(side)
    found = measured.join(side, measured[host].eqNullSafe(side["__h"]) & measured[path].eqNullSafe(side["__pp"]))
    place = (F.greatest(F.lit(0.0), F.col("__s") - F.col("__p")) + narrow * F.col("__m")) / (F.col("__n") - 1 + narrow)
    place = F.least(F.lit(0.99), F.greatest(F.lit(0.01), place))
    moved = F.col("__logit") + F.log(place / (1 - place)) - float(np.log(mu / (1 - mu)))
    return found.select(
        *carry, F.col("__p").alias("__evidence"), place.alias("__place"),
        F.when(F.col("__words") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-moved))).alias("__score"),
    )


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score isn't below ``REJECT_BELOW``; columns as in ``docs``."""
    docs, names = C.renamed(docs, "doc_id", "text", "source", "lang")
    return judge(docs, labels, docs.columns).filter(F.col("__score") >= REJECT_BELOW).select(*docs.columns).toDF(*names)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "source", "lang"])
    return found.select(
        "doc_id", F.col("__evidence").alias("evidence"), F.col("__place").alias("place"), F.col("__score").alias("score"),
        (F.col("__score") >= REJECT_BELOW).alias("kept"),
    )
