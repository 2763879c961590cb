"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by a seeded hash of the whole row into buckets of a bounded size; pass two shuffles every
bucket in memory (Spark's ``shuffle`` is a Fisher-Yates shuffle with a seed).  The buckets in order form one
random sequence of all rows, which is dealt to the shards in turn: shard = place mod n, slot = place div n, so
the shards' counts are at most one apart (law ``rows``).  All steps are DataFrame operations.

Rows alike in all columns hash alike.  More than ``bucket_rows`` of them are counted, kept once, and made anew one by one with a
running number that takes part in their hash: no bucket outgrows its bound, and no result depends on how the input is cut.

Scale: one scan counts the rows by 128 bits of hash (16 bytes a row are shuffled), one shuffle moves each row once; the
buckets' first places are running sums in two steps, over ``BUCKETS_A_GROUP`` buckets and over the groups.

Nulls and odd input: a null text has 0 bytes, size 1 and the crc32 of the empty text; equal rows stay separate rows; an empty
table gives an empty result; further columns are carried as they are, whatever their names and types (``shard`` and ``slot`` are
replaced).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import renamed, settle, shared_dir

SEED = 20_011
N_SHARDS = 8
#: Partitions that hold all buckets, at most.
PARTITIONS = 100_000
BUCKETS_A_GROUP = 4096
#: Equal rows that one generated array numbers.
RUN = 10_000


def n_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _hashable(value: Column, kind: T.DataType) -> Column:
    """The value, as text if it holds a map anywhere."""
    if isinstance(kind, T.MapType):
        return F.to_json(value)
    return F.to_json(F.struct(value)) if '"map"' in kind.json() else value


def _numbered(hot: DataFrame) -> DataFrame:
    """``hot`` with one row for each of its ``__n`` equal rows, numbered by ``__j``; spread over tasks in runs."""
    runs = hot.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN))))
    each = runs.repartition(F.col("__h0"), F.col("__h1"), F.col("__run")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(RUN - 1))))
    return each.withColumn("__j", F.col("__run") * RUN + F.col("__i")).filter("__j < __n").drop("__run", "__i")


def _first_places(counts: DataFrame) -> DataFrame:
    """__bucket and __first, the number of rows in the buckets before it."""
    grouped = settle(counts.withColumn("__group", F.floor(F.col("__bucket") / BUCKETS_A_GROUP)), "buckets")

    def before(order: str, *by: str):
        return W.Window.partitionBy(*by).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)

    groups = grouped.groupBy("__group").agg(F.sum("__n").alias("__all"))
    start = groups.select("__group", F.coalesce(F.sum("__all").over(before("__group")), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("__n").over(before("__bucket", "__group")), F.lit(0))
    return grouped.withColumn("__inside", inside).join(start, "__group").select("__bucket", (F.col("__start") + F.col("__inside")).alias("__first"))


def shard(
    rows: DataFrame, text: str = "text", n_shards: int = N_SHARDS, seed: int = SEED, bucket_rows: int = 1024, bucket_bytes: int = 4 << 20
) -> DataFrame:
    """``rows`` with ``shard`` int and ``slot`` long added (columns of these names are replaced).

    Each shard's slots are gapless from 0; shards differ by one row at most.
    """
    rows, names = renamed(rows.drop("shard", "slot"), text)
    columns = rows.columns
    # Maps have no hash of their own; a hash passes nulls over, so their places are hashed too.
    parts = [_hashable(F.col(f.name), f.dataType) for f in rows.schema] + [F.isnull(c) for c in columns]
    marked = rows.withColumns({f"__h{i}": F.xxhash64(F.lit(2 * seed + i), *parts) for i in (0, 1)})
    alike = settle(marked.groupBy("__h0", "__h1").agg(F.count(F.lit(1)).alias("__n"), F.sum(n_bytes(text)).alias("__size")), "alike")
    n, size = alike.agg(F.sum("__n"), F.sum("__size")).first()
    buckets = max(1, math.ceil((n or 0) / bucket_rows), math.ceil((size or 0) / bucket_bytes))

    def scattered(df: DataFrame, number) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64("__h0", "__h1", number), F.lit(buckets)))

    zero = F.lit(0).cast("long")
    few, hot = alike.filter(F.col("__n") <= bucket_rows), alike.filter(F.col("__n") > bucket_rows).select("__h0", "__h1", "__n")
    counted, moved = scattered(few, zero).select("__bucket", "__n"), scattered(marked, zero)
    if not hot.isEmpty():
        one = marked.join(hot.drop("__n"), ["__h0", "__h1"], "left_semi").groupBy("__h0", "__h1").agg(F.first(F.struct(*columns)).alias("__x"))
        again = _numbered(one.join(hot, ["__h0", "__h1"]))
        moved = scattered(marked.join(hot, ["__h0", "__h1"], "left_anti"), zero).unionByName(
            scattered(again, F.col("__j")).select(*[F.col("__x").getField(c).alias(c) for c in columns], "__h0", "__h1", "__bucket")
        )
        counted = counted.unionByName(scattered(_numbered(hot), F.col("__j")).select("__bucket", F.lit(1).cast("long").alias("__n")))
    first = _first_places(counted.groupBy("__bucket").agg(F.sum("__n").alias("__n")))
    # The order inside a bucket is fixed before the shuffle, so that a task run again gives the same rows.
    mixed = (
        moved.repartition(min(buckets, PARTITIONS), "__bucket")
        .sortWithinPartitions("__bucket", "__h0", "__h1")
        .groupBy("__bucket")
        .agg(F.collect_list(F.struct(*columns)).alias("__rows"))
        .select("__bucket", F.posexplode(F.shuffle("__rows", seed)).alias("__at", "__row"))
    )
    place = F.col("__first") + F.col("__at")
    return mixed.join(first, "__bucket").select(
        *[F.col("__row").getField(c).alias(c) for c in columns],
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(place / n_shards).cast("long").alias("slot"),
    ).toDF(*names, "shard", "slot")


def write_shards(rows: DataFrame, path: str, **options) -> DataFrame:
    """Write ``shard(rows)`` as Parquet and read it back: one folder a shard, files of whole buckets, each in order of its slots."""
    placed = shard(rows, **options)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return written.select(
        "doc_id", (n_bytes() + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
