"""Toxicity by weak supervision.

Voters look at a text and fire or not: fixed lexicons of insults, patterns (shouting, masked words, address), and stems
mined from labelled training rows (words and word beginnings, seen once, repeatedly or densely, whose texts are toxic far
more often than others).  A voter
"silence" fires when no other does.  A generative label model estimates by EM, over the votes on all training rows, how
often each voter fires on toxic and on other texts; labelled training rows enter with their labels.  Voters that fire
together within a class more than their rates explain are correlated; their votes are discounted by the sum of these
correlations.  The model's posteriors are the labels on which a linear classifier over stems and patterns is trained, on
training rows with and without labels alike; its log odds are then stretched and shifted to fit the labelled ones.

A training row has crc32(doc_id as text) mod 3 other than 1.  A score uses the text alone.

Scale: stems come from at most ``SAMPLE_ROWS`` labelled rows, the classifier from the posteriors of as many training rows by
the hash of their ids; votes are counted over all training rows (one small row for each vote pattern is shuffled).  One pass
without a shuffle reads all texts (in slices of ``common.BLOCK_BYTES``) and writes the numbers of what fires in them; votes,
fits and scores read that table.

Nulls and odd input: null and empty texts have no words and get the score of a text in which nothing fires; a null doc_id
is no training row and not held out; without labels the fixed voters start the label model and the classifier is trained on its
posteriors; labels of one class alone make every score low or high; an empty table gives an empty result; further columns don't
matter; texts are read whole; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import linear

SAMPLE_ROWS = linear.SAMPLE_ROWS
#: Stems that vote, and stems that the classifier looks at (the strongest by likelihood ratio).
VOTERS = 128
STEMS = 512
#: A stem is dense in a text if it makes one in so many words.
DENSE = 150
#: Distinct vote patterns that one task sums up.
PATTERNS_A_TASK = 50_000
PRIOR = 0.1
ROUNDS = 8
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b[^\w\s]{1,3}")
_MASKED = re.compile(r"\b\w[*#@$]{2,}\w?\b")
_ADDRESS = re.compile(r"\b(?:you|your|du|ihr|tu|vous|eres|sois)\b", re.I)
#: General insults in groups; each group is a voter.
LEXICONS = (
    frozenset("idiot idiots moron morons imbecile stupid dumb fool dimwit halfwit cretin".split()),
    frozenset("loser losers pathetic worthless useless clown failure coward".split()),
    frozenset("scum trash garbage vermin filth filthy disgusting vile pig rat".split()),
    frozenset("dummkopf trottel depp idiotin arschloch connard salaud imbécile crétin tonto estúpido imbécil basura escoria".split()),
)
PATTERNS = len(LEXICONS) + 4


def training(column: Column) -> Column:
    """Whether a document is a training row, by its id."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def _levels(counts: Counter, n_words: int) -> Iterator[str]:
    """A stem's features: seen once, twice, three times at least, and at least twice and once in ``DENSE`` words."""
    for base, n in counts.items():
        yield f"{base}:1"
        if n > 1:
            yield f"{base}:2"
            if n > 2:
                yield f"{base}:3"
            if n * DENSE >= n_words:
                yield f"{base}:d"


def stems(text: str) -> set[str]:
    """Features of all words in lower case and of their beginnings of 4 to 8 letters (marked with a star)."""
    words = Counter(_WORD.findall(text.lower()))
    counts = Counter(words)
    for w, n in words.items():
        for k in range(4, min(len(w), 9)):
            counts[w[:k] + "*"] += n
    return set(_levels(counts, sum(words.values())))


class Lexicon:
    """The mined stem features, by number."""

    def __init__(self, features: list[str]):
        self.number = {f: i for i, f in enumerate(features)}
        self.bases = frozenset(f.rsplit(":", 1)[0] for f in features)
        self.heads = frozenset(b.rstrip("*")[:4] for b in self.bases)

    def look(self, text: str) -> tuple[list[int], Counter]:
        """The numbers of the features in ``text``, and its words."""
        words, counts = Counter(_WORD.findall(text.lower())), Counter()
        for w, n in words.items():
            if w[:4] in self.heads:
                if w in self.bases:
                    counts[w] += n
                for k in range(4, min(len(w), 9)):
                    part = w[:k] + "*"
                    if part in self.bases:
                        counts[part] += n
        return sorted(self.number[f] for f in _levels(counts, sum(words.values())) if f in self.number), words


def _patterns(text: str, words: Counter) -> list[int]:
    hits = [bool(words.keys() & x) for x in LEXICONS]
    some = any(hits)
    return [*map(int, hits), int(sum(len(words.keys() & x) for x in LEXICONS) > 1), int(len(_SHOUT.findall(text)) > 2), int(bool(_MASKED.search(text))), int(some and bool(_ADDRESS.search(text)))]


def mine(sample: DataFrame) -> list[str]:
    """The stems most associated with toxic texts, strongest first; at most ``STEMS``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label")):
                found = sorted(stems(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label.as_py()] * len(found), pa.float64())], ["stem", "label"])

    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not toxic or toxic >= n:
        return []
    counted = sample.select("text", "label").mapInArrow(explode, "stem string, label double").groupBy("stem").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("t")
    )
    counted = C.settle(counted.filter("n >= 3"), "stems")
    # A stem counts if its share of toxic texts is further above the whole's than chance would make one of all stems
    # (log likelihood ratio against the number of stems looked at).
    rate, c = toxic / n, F.col
    rest = F.greatest(c("n") - c("t"), F.lit(1e-9))
    ratio = c("t") * F.log(c("t") / (c("n") * rate)) + rest * F.log(rest / (c("n") * (1 - rate)))
    some = counted.withColumn("ratio", F.when(c("t") > c("n") * rate, ratio).otherwise(0.0))
    bound = math.log(max(2, some.count()))
    strong = some.filter((c("ratio") >= bound) & (c("t") / c("n") >= min(0.5, 4 * rate)))
    # Beginnings of one word with equal counts say the same; the first of them stands for all.
    out = {}
    for r in strong.orderBy(F.desc("ratio"), "stem").limit(4 * STEMS).collect():
        out.setdefault((r.stem[:4], r.n, r.t), r.stem)
    return list(out.values())[:STEMS]


def _votes(found: list[int], patterns: list[int]) -> list[int]:
    fired = [i for i, p in enumerate(patterns) if p] + [PATTERNS + i for i in found if i < VOTERS]
    return fired or [PATTERNS + VOTERS]


class LabelModel:
    """Firing rates of every voter in both classes, and the voters' discounts."""

    def __init__(self, rates: np.ndarray, prior: float):
        self.rates, self.prior, self.discount = rates, prior, np.ones(rates.shape[1])

    def weights(self) -> np.ndarray:
        return np.log(self.rates[1] / self.rates[0]) * self.discount

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return linear.sigmoid(votes @ self.weights() + np.log(self.prior / (1 - self.prior)))


def _dense(patterns: list, m: int) -> np.ndarray:
    out = np.zeros((len(patterns), m))
    for i, p in enumerate(patterns):
        out[i, p] = 1
    return out


def _sums(patterns: DataFrame, model: LabelModel, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts by class: rows, firings, and (if asked) joint firings; m * m numbers a task at most."""
    m = len(model.discount)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + m + (m * m if pairs else 0)))
        for batch in batches:
            votes, n = _dense(batch.column("votes").to_pylist(), m), batch.column("n").to_numpy()
            p = model.posterior(votes)
            for k, r in enumerate(((1 - p) * n, p * n)):
                total[k, 0] += r.sum()
                total[k, 1 : 1 + m] += r @ votes
                if pairs:
                    total[k, 1 + m :] += ((votes * r[:, None]).T @ votes).ravel()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], ["k", "v"])

    out = np.zeros(2 * (1 + m + (m * m if pairs else 0)))
    for r in patterns.mapInArrow(expect, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    out = out.reshape(2, -1)
    return out[:, 0], out[:, 1 : 1 + m], out[:, 1 + m :].reshape(2, m, m) if pairs else out[:, :0]


def label_model(patterns: DataFrame, known_rows: np.ndarray, known_fired: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """EM over vote patterns (votes array<int>, n); known_*: counts by class of labelled rows, entered as they are."""
    m = known_fired.shape[1]
    start = np.array([np.full(m, 0.02), np.full(m, 0.2)])
    start[:, -1] = (0.9, 0.2)
    weight = 2.0
    rates = (known_fired + weight * start) / (known_rows[:, None] + weight)
    prior = (known_rows[1] + PRIOR) / (known_rows.sum() + 1)
    model = LabelModel(np.clip(rates, 1e-4, 1 - 1e-4), float(np.clip(prior, 0.005, 0.5)))
    for i in range(rounds):
        rows, fired, both = _sums(patterns, model, pairs=i in (0, rounds // 2))
        if both.size:
            mean = fired / np.maximum(rows[:, None], 1e-9)
            joint = both / np.maximum(rows[:, None, None], 1e-9)
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            excess = (joint - mean[:, :, None] * mean[:, None, :]) / (spread[:, :, None] * spread[:, None, :])
            share = rows / max(rows.sum(), 1e-9)
            correlation = np.clip(np.tensordot(share, excess, 1), 0, 1)
            np.fill_diagonal(correlation, 0)
            model.discount = 1 / (1 + correlation.sum(1))
        # Labelled rows are among the patterns too; a fixed share of the evidence is kept for their labels.
        all_rows, all_fired = rows + 4 * known_rows, fired + 4 * known_fired
        model.rates = np.clip((all_fired + weight * start) / (all_rows[:, None] + weight), 1e-4, 1 - 1e-4)
        model.prior = float(np.clip((all_rows[1] + PRIOR) / (all_rows.sum() + 1), 0.005, 0.5))
    return model


LOOKED = "votes array<int>, features array<int>"


def look(docs: DataFrame, known: Lexicon, carry: list[str]) -> DataFrame:
    """``carry`` columns, votes and features of every row of ``docs`` (text): all that the models need of a text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema), LOOKED])
    kind = pa.list_(pa.int32())

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.by_bytes(whole, "__text"):
                votes, features = [], []
                for text in batch.column("__text"):
                    text = text.as_py() or ""
                    found, words = known.look(text)
                    patterns = _patterns(text, words)
                    votes.append(_votes(found, patterns))
                    features.append([i for i, p in enumerate(patterns) if p] + [PATTERNS + i for i in found])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(votes, kind), pa.array(features, kind)], [*carry, "votes", "features"])

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(see, schema)


class Scorer(NamedTuple):
    """The linear classifier: the mined stems, a weight for each pattern and stem."""

    known: Lexicon
    weights: np.ndarray
    intercept: float


def calibrated(weights: np.ndarray, intercept: float, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The classifier with its log odds stretched and shifted to fit the labels y of the rows x."""
    if len(set(y)) < 2:
        return weights, intercept
    slope, shift = linear.fit((x @ weights + intercept)[:, None], y, ridge=1e-3, standard=False)
    return (weights * slope[0], intercept * slope[0] + shift) if slope[0] > 0 else (weights, intercept)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Scorer, DataFrame]:
    """A scorer from the training rows of ``docs`` (doc_id, text) and their ``labels`` (doc_id, toxic), and ``look`` at all rows.

    The classifier learns the posteriors of at most ``rows`` training rows, by a hash of the id; labelled rows are looked at
    (at most ``rows`` of them) to mine stems, to anchor the label model and to calibrate.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = C.settle(linear.labelled(docs, labels, "toxic", rows, training(F.col("doc_id"))).select("doc_id", "text", "label"), "toxic-sample")
    known = Lexicon(mine(sample))
    m = PATTERNS + VOTERS + 1
    looked = C.settle(look(docs, known, ["doc_id"]), "looked")
    own = looked.filter(training(F.col("doc_id")))
    patterns = C.settle(own.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "votes")
    # Every task of a round gives m * m sums, so the (small) table of patterns goes to no more tasks than it needs.
    patterns = patterns.coalesce(1 + patterns.count() // PATTERNS_A_TASK)
    gold = look(sample, known, ["label"]).collect()
    votes, y = _dense([r.votes for r in gold], m), np.array([r.label for r in gold])
    known_rows = np.array([(y == 0).sum(), (y == 1).sum()], float)
    known_fired = np.array([votes[y == 0].sum(0), votes[y == 1].sum(0)])
    model = label_model(patterns, known_rows, known_fired)
    some = linear.first_by_hash(own, rows, 23).select("votes", "features").collect()
    if not some:
        return Scorer(known, np.zeros(PATTERNS + STEMS), float(np.log(model.prior / (1 - model.prior)))), looked
    x, posterior = _dense([r.features for r in some], PATTERNS + STEMS), model.posterior(_dense([r.votes for r in some], m))
    weights, intercept = linear.fit(x, posterior, standard=False)
    return Scorer(known, *calibrated(weights, intercept, _dense([r.features for r in gold], PATTERNS + STEMS), y)), looked


def score(looked: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of every row of ``looked`` (doc_id, features)."""
    weights, intercept = scorer.weights, scorer.intercept

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column("features")
            upto = np.r_[0.0, np.cumsum(weights[features.flatten().to_numpy(zero_copy_only=False)])]
            ends = features.offsets.to_numpy() - features.offsets.to_numpy()[0]
            z = intercept + np.round(upto[ends[1:]] - upto[ends[:-1]], 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(linear.sigmoid(z))], ["doc_id", "score"])

    return looked.select("doc_id", "features").mapInArrow(rate, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer, looked = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return score(looked, scorer).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
