"""Exact order statistics of groups of any size, by counting into ever narrower bins.

Each round counts the values between the bounds of every wanted rank in ``BINS`` bins, before rows are
shuffled, and goes on with the bin that holds the rank, from its least to its greatest value.  It ends when these are
equal.  No values of a group meet in one task or one buffer, however many or how unevenly spread they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.sources.shared import keep, release

BINS = 1024


def order_statistics(values: DataFrame, ranks: DataFrame, value: str, by: str = "plot") -> DataFrame:
    """(by, rank, value): for each of ``ranks`` (by, rank), the value with as many values before it; numbers without nulls, NaN and infinities.

    Ranks beyond a group's values have no row."""
    ends = values.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    left = keep(ranks.distinct().join(ends, by).where("rank >= 0 AND rank < n").select(by, "rank", "lo", "hi", F.lit(0).cast("long").alias("below")))
    done, rounds = [], []
    while True:
        rounds.append(left)
        done.append(left.where("lo = hi").select(by, "rank", F.col("lo").alias(value)))
        open_ = left.where("lo < hi")
        if open_.isEmpty():
            break
        ranges = open_.select(by, "lo", "hi").distinct()
        within = values.select(by, F.col(value).alias("v")).join(ranges, by).where("v BETWEEN lo AND hi")
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = within.groupBy(by, "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("n").over(W.partitionBy(by, "lo", "hi").orderBy("bin")) - F.col("n")
        counted = bins.withColumn("before", before)
        mine = open_.join(counted, [by, "lo", "hi"]).withColumn("at", F.col("below") + F.col("before")).where("rank >= at AND rank < at + n")
        left = keep(mine.select(by, "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("at").alias("below")))
    out = keep(reduce(DataFrame.unionByName, done))
    release(*rounds)
    return out


def percentiles(values: DataFrame, shares: Sequence[float], value: str, by: str = "plot") -> DataFrame:
    """(by, share, value): the exact percentiles, between two neighbours in proportion; values without nulls."""
    at = values.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("h", F.col("share") * (F.col("n") - 1))
    low, high = F.floor("h"), F.ceil("h")
    found = order_statistics(values, at.select(by, F.explode(F.array(low, high)).alias("rank")), value, by)
    sides = at.withColumn("low", low).withColumn("high", high)
    for side in ("low", "high"):
        sides = sides.join(found.select(by, F.col("rank").alias(side), F.col(value).alias(f"_{side}")), [by, side])
    mixed = F.when(F.col("low") == F.col("high"), F.col("_low")).otherwise((F.col("high") - F.col("h")) * F.col("_low") + (F.col("h") - F.col("low")) * F.col("_high"))
    return sides.select(by, "share", mixed.alias(value))
