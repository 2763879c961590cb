"""A corpus pipeline: quality, near duplicates, benchmark decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its Parquet is the next one's docs.  All but the last
return the columns of documents; the last adds shard and slot.

Nulls and odd input: quality rejects null and wordless texts, and a document without a source or language is judged by the
place "none"; a null doc_id is an id like any other (two such rows are two documents); repeated rows leave one at near_duplicates;
very long texts are read whole by every stage; an empty table passes all stages empty; further columns of documents are kept,
but for columns named shard and slot, which the last stage replaces; without labels quality rejects only wordless texts, without
a benchmark decontamination rejects none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shortlist.llm import common, op01_sharding, op04_mixing, op05_minhash, op06_quality, op09_decontamination


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return op06_quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return op05_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return op09_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay 0, 1 or 2 times, so that sources meet their targets."""
    return op04_mixing.mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their shard and their slot in it."""
    return op01_sharding.shard(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The random stages and the alignment can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return docs
