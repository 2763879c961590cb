"""Merging worker shards while they grow: a file stream whose micro-batches are merged by key, or kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def merge_stream(spark: SparkSession, shards: str, target: str, checkpoint: str, schema: str, keys: list[str], sequence: str) -> None:
    """Read all shards there are (and later ones on the next call) and keep the last record of each key under ``target``.

    Every micro-batch becomes one part, named by its number, so that a batch run twice replaces itself; ``merged`` reads the
    parts.  Declared keys bound the result, so no watermark is needed.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(sequence, *[c for c in rest if c != sequence])).alias("r")).select(*keys, "r.*")
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(shards)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merged(spark: SparkSession, target: str, keys: list[str], sequence: str) -> DataFrame:
    """The last record of each key over all parts; a later sequence wins, then a later batch."""
    parts = spark.read.option("basePath", target).parquet(target)
    rest = [c for c in parts.columns if c not in (*keys, "batch")]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(sequence, "batch")).alias("r")).select(*keys, "r.*")


def progress(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Keys completed after each batch: counts of first appearances, summed up over batches."""
    first = spark.read.option("basePath", target).parquet(target).groupBy(*keys).agg(F.min("batch").alias("batch"))
    counts = first.groupBy("batch").agg(F.count(F.lit(1)).alias("new"))
    return counts.withColumn("completed", F.sum("new").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))


def merge_stateful(spark: SparkSession, shards: str, progress: str, checkpoint: str, schema: str, keys: list[str], sequence: str) -> None:
    """As ``merge_stream``, with the last record of each key held in keyed state instead of parts that are merged at each read.

    A record replaces the held one if its sequence is greater (a tie: if its other values are, nulls first).  After every micro-batch a row
    (new, completed) is written below ``progress``: keys seen for the first time, and all so far.  State and offsets are in
    ``checkpoint``, so the next call (or a restart after a failure) goes on where the last one ended; ``held`` reads the records from there.
    """
    fields = T._parse_datatype_string(schema)
    rest = [f.name for f in fields if f.name not in keys]
    state = T.StructType([f for f in fields if f.name in rest])

    def number(batch: DataFrame, n: int) -> None:
        new = batch.agg(F.count_if("new")).first()[0]
        before = 0
        if n:
            before = spark.read.schema("new long, completed long, batch long").option("basePath", progress).parquet(progress).filter(F.col("batch") < n).agg(F.max("completed")).first()[0] or 0
        spark.createDataFrame([(new, before + new)], "new long, completed long").coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={n}")

    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(shards)
        out = stream.groupBy(*keys).transformWithStateInPandas(_LastWins(state, rest, sequence), "new boolean", "Update", "None")
        query = out.writeStream.foreachBatch(number).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class _LastWins(StatefulProcessor):
    """Keeps the last record of a key; tells whether the key is new."""

    def __init__(self, state: T.StructType, columns: list[str], sequence: str):
        self.state, self.columns, self.sequence = state, columns, sequence
        self.order = [sequence, *(c for c in columns if c != sequence)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rank = lambda r: [(r[c] is not None, r[c]) for c in self.order]
        known = self.last.exists()
        best = dict(zip(self.columns, self.last.get())) if known else None
        changed = False
        for frame in rows:
            for row in frame[self.columns].astype(object).where(frame[self.columns].notna(), None).to_dict("records"):
                if best is None or rank(row) > rank(best):
                    best, changed = row, True
        if changed:
            self.last.update(tuple(best[c] for c in self.columns))
        yield pd.DataFrame({"new": [not known]})

    def close(self) -> None:
        pass


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last record of each key, from the state of ``merge_stateful``; nothing is merged again."""
    found = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return found.select("key.*", "value.*")


def completed(spark: SparkSession, progress: str) -> DataFrame:
    """batch, new, completed of every micro-batch."""
    return spark.read.option("basePath", progress).parquet(progress).select("batch", "new", "completed")
