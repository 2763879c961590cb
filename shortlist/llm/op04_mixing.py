"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; its documents get the same expected number of copies, target / source size.
The whole part is sure; the fractional parts are rounded together: two fractional documents are paired and words
of mass move between them, at random but without bias, until one of them is integral.  Their sum in words doesn't
change, so that a source ends within one document of its target.  Rounding runs as a reduction tree: documents
are rounded in chunks of about ``fan_in``, each chunk leaves at most one fractional document, and these residuals
meet in the chunks of the next level.  All steps are DataFrame operations.

Scale: rows that agree in source, id, size and text are counted first (map-side) and rounded as one item with a
multiplicity; one shuffle moves small item rows to their chunks; each further level has 1 / fan_in of the rows.
Nothing but one number (the largest source's item count) comes to the driver.  The table of sources (one small row
each) is ordered in one task, since weights follow the order of the names.

Randomness is a hash of seed, level and item, so reruns agree however the input is partitioned.

Nulls and odd input: a null source is a source of its own (last in order); a null text has size 0; documents of
size 0 take 0 words and, where rows are returned, int(copies) of them stay; equal rows share the copies of their
item, at most 2 each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import renamed, settle

SEED = 40_007
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed by the contract: weights repeat in the order of the names, the share of all words, the most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Sources up to this number are broadcast, more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _items(docs: DataFrame) -> DataFrame:
    """One row for equal (source, doc_id, size, text): n, the number of such rows."""
    return (
        docs.select("source", "doc_id", n_words().alias("size"), F.xxhash64("text").alias("text_hash"))
        .groupBy("source", "doc_id", "size", "text_hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size -> with weight and target: share by weight, cut at most * size, the excess reshared.

    That ends at one level for all sources that aren't cut: target = least of cap and level * weight.  Sources in the
    order of cap / weight are cut one after the other; the level is that of the first that isn't.
    """
    ordered = W.Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1)
    )
    s = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    fill = W.Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    before, after, whole = (
        fill.rowsBetween(W.Window.unboundedPreceding, -1),
        fill.rowsBetween(0, W.Window.unboundedFollowing),
        fill.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing),
    )
    s = s.withColumn(
        "level",
        (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    cut = F.col("level") * F.col("weight") >= F.col("cap")
    first = F.min(F.when(~cut, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").alias("name"), F.col("level").alias("level"))))
    s = s.withColumn("final", first.over(whole)["level"])
    return s.select(
        "source", "source_size", "items", "weight",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"),
    )


def _uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1), from a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def _pivot(state: Column, item: Column) -> Column:
    """Pair the fractional document at hand with the next one; one of them gets integral and is done.

    In words, ``up`` can move to the one at hand and ``down`` from it; it moves up with probability down / (up + down).
    """
    held = state["held"]
    up = F.least((1 - held["p"]) * held["size"], item["p"] * item["size"])
    down = F.least(held["p"] * held["size"], (1 - item["p"]) * item["size"])

    def let(column: Column, use) -> Column:
        return F.element_at(F.transform(F.array(column), use), 1)

    def changed(x: Column, p: Column, u: Column) -> Column:
        return F.struct(x["item"].alias("item"), x["size"].alias("size"), p.cast("double").alias("p"), u.alias("u"))

    def moved(m: Column) -> Column:
        h_full, i_empty = m["up"] >= (1 - held["p"]) * held["size"], F.lit(0.0)
        to_held = F.struct(
            changed(held, F.when(h_full, 1.0).otherwise(held["p"] + m["up"] / held["size"]), held["u"]).alias("held"),
            changed(item, F.when(h_full, item["p"] - m["up"] / item["size"]).otherwise(i_empty), item["u"]).alias("item"),
            h_full.alias("held_done"),
        )
        h_empty = m["down"] >= held["p"] * held["size"]
        to_item = F.struct(
            changed(held, F.when(h_empty, 0.0).otherwise(held["p"] - m["down"] / held["size"]), held["u"]).alias("held"),
            changed(item, F.when(h_empty, item["p"] + m["down"] / item["size"]).otherwise(1.0), item["u"]).alias("item"),
            h_empty.alias("held_done"),
        )
        return F.when(item["u"] * (m["up"] + m["down"]) < m["down"], to_held).otherwise(to_item)

    def finish(r: Column) -> Column:
        done = F.when(r["held_done"], r["held"]).otherwise(r["item"])
        rest = F.when(r["held_done"], r["item"]).otherwise(r["held"])
        one = F.struct(done["item"].alias("item"), (done["p"] >= 0.5).cast("int").alias("up"))
        return F.struct(F.array_append(state["done"], one).alias("done"), rest.alias("held"))

    return let(F.struct(up.alias("up"), down.alias("down")), lambda m: let(moved(m), finish))


def copies(items: DataFrame, sources: DataFrame, n_sources: int, seed: int = SEED, fan_in: int = 64) -> DataFrame:
    """items with source_size, target and ``copies``, the copies that all n rows of the item have together.

    ``items`` should be settled: it is read once a level.
    """
    small = n_sources <= BROADCAST_SOURCES
    side = F.broadcast(sources) if small else sources
    key = ["source", "doc_id", "size", "text_hash"]
    due = items.join(side, items.source.eqNullSafe(sources.source)).drop(sources.source)
    due = due.withColumn("due", F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0))
    due = due.withColumn("sure", F.floor("due")).withColumn("p", F.col("due") - F.col("sure"))
    kept = ["source_size", "target", "n", "sure"]
    entries = F.col("p") > 0
    sure = due.filter(~entries | (F.col("size") == 0)).select(*key, *kept, F.lit(0).alias("up"))
    parts = due.filter(entries & (F.col("size") > 0))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("items") / fan_in))
    level = parts.select(
        "source", chunks.alias("chunks"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash"), chunks).alias("chunk"),
        F.struct(F.struct(*key, *kept).alias("item"), F.col("size").cast("double").alias("size"), "p").alias("x"),
    )
    most = sources.agg(F.max("items")).first()[0] or 0
    left, depth, out = -(-most // fan_in), 0, [sure]
    while True:
        drawn = F.transform(
            F.array_sort(F.collect_list("x")),
            lambda x, d=depth: F.struct(x["item"].alias("item"), x["size"].alias("size"), x["p"].alias("p"),
                                        _uniform(seed + 1 + d, x["item"]["doc_id"], x["item"]["size"], x["item"]["text_hash"]).alias("u")),
        )
        grouped = level.groupBy("source", "chunk", "chunks").agg(drawn.alias("xs"))
        none = F.expr("slice(transform(xs, x -> struct(x.item as item, 0 as up)), 1, 0)")
        folded = grouped.select(
            "source", "chunk", "chunks",
            F.aggregate(
                F.slice("xs", 2, F.size("xs")), F.struct(none.alias("done"), F.element_at("xs", 1).alias("held")), _pivot
            ).alias("r"),
        )
        folded = settle(folded, f"mixing-{depth}")
        done = folded.select(F.explode("r.done").alias("d"))
        out.append(done.select("d.item.*", "d.up"))
        held = folded.select("source", "chunk", "chunks", F.col("r.held").alias("x"))
        if left <= 1:
            break
        left, depth = -(-left // fan_in), depth + 1
        fewer = F.greatest(F.lit(1), F.ceil(F.col("chunks") / fan_in))
        level = held.select(
            "source", fewer.alias("chunks"), F.floor(F.col("chunk") / fan_in).alias("chunk"),
            F.struct(F.col("x.item").alias("item"), F.col("x.size").alias("size"), F.col("x.p").alias("p")).alias("x"),
        )
    last = _uniform(seed, F.col("x.item.doc_id"), F.col("x.item.text_hash")) < F.col("x.p")
    out.append(held.select("x.item.*", last.cast("int").alias("up")))
    whole = [x.select(*key, *kept, (F.col("sure") + F.col("up")).cast("long").alias("copies")) for x in out]
    result = whole[0]
    for x in whole[1:]:
        result = result.unionByName(x)
    return result


def decide(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each item of ``docs``: source, doc_id, size, text_hash, n, source_size, target, copies."""
    items = settle(_items(docs), "mixing-items")
    sources = settle(
        targets(
            items.groupBy("source").agg(
                F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("items")
            )
        ),
        "mixing-sources",
    )
    return copies(items, sources, sources.count(), seed)


def _each(item: DataFrame, total: str, block: int = 4096) -> DataFrame:
    """Repeat every row as often as the column ``total`` says, with its number ``j`` from 0; in blocks."""
    blocks = item.filter(F.col(total) > 0).withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col(total) - 1) / block))))
    last = F.least(F.lit(block), F.col(total) - F.col("__b") * block) - 1
    inner = blocks.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return inner.withColumn("j", F.col("__b") * block + F.col("__i")).drop("__b", "__i")


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to 2 times); columns as in ``docs``."""
    docs, names = renamed(docs, "doc_id", "source", "text")
    key = ["__s", "__d", "__w", "__h"]
    mix = decide(docs, seed).filter("copies > 0").select(
        F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("size").alias("__w"),
        F.col("text_hash").alias("__h"), F.col("n").alias("__n"), F.col("copies").alias("__copies"),
    )
    keyed = docs.withColumns({"__w0": n_words(), "__h0": F.xxhash64("text")})
    found = keyed.join(
        mix,
        keyed.doc_id.eqNullSafe(mix["__d"]) & keyed.source.eqNullSafe(mix["__s"])
        & (keyed["__w0"] == mix["__w"]) & (keyed["__h0"] == mix["__h"]),
    )
    single = found.filter(F.col("__n") == 1)
    repeated = found.filter(F.col("__n") > 1).dropDuplicates(key)
    return _each(single, "__copies").select(*docs.columns).unionByName(_each(repeated, "__copies").select(*docs.columns)).toDF(*names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("j") < F.pmod(F.col("copies"), F.col("n"))).cast("long")
    return _each(mix, "n").select("doc_id", "size", "source_size", "target", (own * F.col("size")).cast("long").alias("taken"))
