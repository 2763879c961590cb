"""Reading and writing: split files, teacher artifacts, evaluation results, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
#: Ids on one line of a split file.
BLOCK_IDS = 100_000


def read_split_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of id arrays by split as a table (global_idx, split)."""
    raw = spark.read.schema(", ".join(f"{s} array<long>" for s in SPLITS)).json(path, multiLine=True)
    out = None
    for s in SPLITS:
        part = raw.select(F.explode(s).alias("global_idx"), F.lit(s).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def write_split_parts(assignment: DataFrame, path: str, block: int = BLOCK_IDS) -> None:
    """Splits of any size as JSON lines (split, block, ids) in many files, ``block`` ids or so a line."""
    blocks = max(1, -(-assignment.count() // block))
    keyed = assignment.filter(F.col("split").isin(*SPLITS)).withColumn("block", F.pmod(F.xxhash64("global_idx"), F.lit(blocks)))
    lines = keyed.groupBy("split", "block").agg(F.array_sort(F.collect_list("global_idx")).alias("ids"))
    lines.write.mode("overwrite").json(path)


def read_split_parts(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_split_parts`` wrote as a table (global_idx, split)."""
    lines = spark.read.schema("split string, block long, ids array<long>").json(path)
    return lines.select(F.explode("ids").alias("global_idx"), "split")


def write_teacher(queries: DataFrame, candidates: DataFrame, features: dict[str, DataFrame], summary: DataFrame, path: str) -> None:
    """The training artifact: both tables partitioned by query split, the feature tables by name, the summary as JSON lines."""
    queries.write.mode("overwrite").partitionBy("query_split").parquet(f"{path}/queries")
    candidates.write.mode("overwrite").partitionBy("query_split").parquet(f"{path}/candidates")
    for name, table in features.items():
        table.write.mode("overwrite").parquet(f"{path}/features/{name}")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_results(metrics: DataFrame, run_id: str, path: str, complete: bool = True, records: DataFrame | None = None, keys: list[str] = ["condition"]) -> str:
    """A run's folder: long metrics, their tree as JSON, and (if given) the records; partial runs go to a folder of their own."""
    place = f"{path}/{run_id}" + ("" if complete else "-partial")
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{place}/metrics")
    metric_tree(metrics, keys).write.mode("overwrite").json(f"{place}/tree")
    if records is not None:
        records.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{place}/records")
    return place


def metric_tree(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text a key: metric names to values, null for what JSON has no number for."""
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    tree = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", value.alias("value")))))
    return metrics.groupBy(*keys).agg(F.to_json(tree, {"ignoreNullFields": "false"}).alias("tree"))


def read_tree(spark: SparkSession, place: str, keys: str) -> DataFrame:
    """The tree of a run's folder as long metrics; ``keys``: their names and types."""
    tree = spark.read.schema(f"{keys}, tree string").json(f"{place}/tree")
    names = [k.split()[0] for k in keys.split(", ")]
    return tree.select(*names, F.explode(F.from_json("tree", "map<string,double>")).alias("metric", "value"))


def wide_by_condition(measured: DataFrame, conditions: list[str]) -> DataFrame:
    """One row a query with a column block for each condition (named values, so that no extra job finds them)."""
    m = lambda c: F.first(f"m.{c}").alias(c)
    return measured.groupBy("query_split", "query_idx", "true_class").pivot("condition", conditions).agg(m("predicted"), m("correct"), m("true_rank"), m("margin"))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def export_candidates(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """One row a query with aligned arrays of its candidates' columns, in pool order."""
    rows = F.array_sort(F.collect_list(F.struct("position", *columns)))
    out = candidates.groupBy("query_split", "query_idx").agg(rows.alias("r"))
    return out.select("query_split", "query_idx", *[F.col(f"r.{c}").alias(c) for c in columns])
