"""Exact quantiles of many groups at once, in passes over ranges of values instead of one list a group.

A cell is a range of a group's values.  Cells that hold a wanted rank and more than ``FEW`` values are cut into ``BUCKETS`` equal ranges, of
which those with a wanted rank are the next cells; cells with few values are read and sorted.  What a task holds is
``FEW`` values or ``BUCKETS`` counts a cell, however large a group is.  Ranges shrink by a factor of ``BUCKETS`` a pass, first in magnitude and
then in value, so that any doubles need a handful of passes; cells of one value are done.

Scale: each pass reads the values once; counts are combined before they are shuffled, and only values of small cells are.  The
table of cells (six or so a group) is joined on the group, its size left to Spark's check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch

FEW = 10_000
BUCKETS = 1024


def _magnitude(v: Column) -> Column:
    """A number that grows with v by 1 for each doubling away from zero."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _bucket(v: Column, low: Column, high: Column) -> Column:
    """The range (0 .. BUCKETS - 1) of v between low and high, never smaller for a greater v; low and high are never in one range.

    Ranges are equal in magnitude where the values span many of them, else in value (halved where the width could overflow).
    """
    wide = high / 2 - low / 2
    share = F.when(wide >= 1, (v / 2 - low / 2) / F.greatest(wide, F.lit(1.0))).otherwise((v - low) / F.when(wide < 1, high - low).otherwise(1.0))
    m0, m1 = _magnitude(low), _magnitude(high)
    share = F.when(m1 - m0 > 10, (_magnitude(v) - m0) / F.greatest(m1 - m0, F.lit(1.0))).otherwise(share)
    return F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """``by``, n and q (array of the interpolated quantiles at ``shares``) of each group of ``rows``.

    Nulls and NaN don't count; a group without values has q null and isn't returned if all its rows are null.  Infinite values are
    ordered like others (between a finite and an infinite one the quantile is infinite).
    """
    v = F.col(value).cast("double")
    own = rows.select(F.struct(*by).alias("g"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    groups = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # The ranks below and above each quantile's place, each once.
    places = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    groups = scratch.settle(groups.withColumn("ranks", ranks), "groups")
    # A cell: its group, its least and greatest value, how many values there are below it and in it, the ranks that it holds.
    cells = groups.select("g", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), "ranks")
    found = []
    while True:
        one = F.col("low") == F.col("high")
        found.append(cells.filter(one).select("g", F.explode("ranks").alias("rank"), F.col("low").alias("x")))
        rest = cells.filter(~one)
        small, large = rest.filter(F.col("size") <= few), rest.filter(F.col("size") > few)
        found.append(_read(own, small))
        if large.isEmpty():
            break
        cells = scratch.settle(_cut(own, large), "cells")
    values = reduce(DataFrame.unionByName, found).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    known = groups.select("g", "n").join(values.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))

    def interpolated(place: Column) -> Column:
        low, high = F.element_at("at", F.floor(place).cast("long")), F.element_at("at", F.ceil(place).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return known.select(*[F.col(f"g.`{c}`").alias(c) for c in by], "n", F.array(*[interpolated(p) for p in places]).alias("q"))


def _inside(own: DataFrame, cells: DataFrame) -> DataFrame:
    """The values within some cell, with it; a group's cells don't overlap."""
    listed = cells.groupBy(F.col("g").alias("h")).agg(F.collect_list(F.struct("low", "high", "below", "size", "ranks")).alias("cells"))
    both = own.join(listed, F.col("g").eqNullSafe(F.col("h")))
    return both.select("g", "v", F.explode(F.filter("cells", lambda c: (c["low"] <= F.col("v")) & (F.col("v") <= c["high"]))).alias("c"))


def _read(own: DataFrame, cells: DataFrame) -> DataFrame:
    """g, rank, x of the ranks in cells of few values, whose values are sorted."""
    sorted_ = _inside(own, cells).groupBy("g", "c.below").agg(F.sort_array(F.collect_list("v")).alias("s"), F.first("c.ranks").alias("ranks"))
    return sorted_.select("g", "below", "s", F.explode("ranks").alias("rank")).select("g", "rank", F.get("s", F.col("rank") - F.col("below")).alias("x"))


def _cut(own: DataFrame, cells: DataFrame) -> DataFrame:
    """Those ranges of the cells that hold wanted ranks.  Infinite ends are ranges of their own; the finite values between them are cut."""
    inf = F.lit(float("inf"))
    inside = _inside(own, cells).select("g", "v", "c.low", "c.high", "c.below", "c.ranks")
    infinite = (F.col("low") == -inf) | (F.col("high") == inf)
    # A cell with an infinite end is cut there first: below zero, finite, above.
    bucket = F.when(infinite, F.when(F.col("v") == -inf, 0).when(F.col("v") == inf, 2).otherwise(1)).otherwise(_bucket(F.col("v"), F.col("low"), F.col("high")))
    counts = inside.groupBy("g", F.col("below").alias("b0"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("ranks").alias("wanted")
    )
    before = Window.partitionBy("g", "b0").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("below", F.col("b0") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    held = F.filter("wanted", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("size")))
    return placed.withColumn("ranks", held).filter(F.size("ranks") > 0).select("g", "low", "high", "below", "size", "ranks")
