"""Paired statistics on aggregated counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _mcnemar(a: int, b: int) -> float:
    n, k = a + b, min(a, b)
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    most = max(log)
    return min(1.0, 2 * math.exp(most) * sum(math.exp(x - most) for x in log))


@F.pandas_udf(DoubleType())
def mcnemar(treatment_only: pd.Series, control_only: pd.Series) -> pd.Series:
    """Exact two-sided p of the two discordant counts; 1 if there are none."""
    return pd.Series([_mcnemar(int(a), int(b)) for a, b in zip(treatment_only, control_only)], dtype=float)


def bootstrap(counts: DataFrame, keys: list[str], samples: int = 2000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile interval of the accuracy difference, from n, treatment_only and control_only of each key.

    Resampling pairs is a multinomial draw on three counts, so that the work doesn't grow with n; each key's samples are
    drawn in blocks of 500 in parallel and the seed of a block follows from the key and its number.
    """
    blocks = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // 500))))
    blocks = blocks.withColumn("seed", F.abs(F.xxhash64(F.lit(seed), *keys, "block")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*keys).schema), "difference double"])

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rng = np.random.default_rng(int(r.seed))
                n, size = int(r.n), min(500, samples - 500 * int(r.block))
                p = np.array([r.treatment_only, r.control_only, n - r.treatment_only - r.control_only], float) / max(n, 1)
                got = rng.multinomial(n, p, size=size)
                out = pd.DataFrame({"difference": (got[:, 0] - got[:, 1]) / max(n, 1)})
                for k in keys:
                    out[k] = getattr(r, k)
                yield out[[*keys, "difference"]]

    drawn = blocks.select(*keys, "n", "treatment_only", "control_only", "block", "seed").mapInPandas(draw, schema)
    edge = (1 - level) / 2
    return drawn.groupBy(*keys).agg(F.percentile("difference", F.lit(edge)).alias("low"), F.percentile("difference", F.lit(1 - edge)).alias("high"))
