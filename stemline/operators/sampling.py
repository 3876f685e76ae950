"""Portable samples: order by a draw from the key, so a sample is the same on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.draws import PRIME, draw, normal, whole


def plot_seed(plot: Column, seed: int = 42) -> Column:
    """(seed + CRC-32 of the plot's name) in 31 bits."""
    return (F.crc32(F.encode(plot, "UTF-8")) + seed).bitwiseAND(0x7FFFFFFF)


def cap_per_class(points: DataFrame, most: int = 12_000, by: tuple[str, ...] = ("plot", "label"), key: str = "point_id", seed: int = 42, order: Column | None = None) -> DataFrame:
    """At most ``most`` points per plot and class.  The rank filter is applied within tasks before rows are shuffled."""
    o = draw(seed, *by, key) if order is None else order
    return points.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(o, key))).where(F.col("_r") <= most).drop("_r")


def split_plots(plots: DataFrame, share: float = 0.2, plot: str = "plot", seed: int = 42, order: Column | None = None) -> DataFrame:
    """(plot, split): ceil(share * n) plots are ``val``, chosen by hash order; plots are a small dimension."""
    o = draw(seed, plot) if order is None else order
    p = plots.select(plot).distinct()
    n = F.count("*").over(W.partitionBy())
    rank = F.row_number().over(W.partitionBy().orderBy(o, plot))
    return p.withColumn("split", F.when(rank <= F.ceil(F.lit(share) * n), "val").otherwise("train"))


def block(points: DataFrame, size: int = 8192, by: str = "plot", key: str = "point_id", seed: int = 42) -> DataFrame:
    """``size`` points of each plot with their position: without repeats where the plot has as many, else cycled through the hash order."""
    o = draw(seed, by, key)
    r = points.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(o, key)) - 1).where(F.col("_r") < size)
    n = points.groupBy(by).agg(F.count("*").alias("_n"))
    copies = F.when(F.col("_n") >= size, F.array(F.col("_r"))).otherwise(F.sequence(F.col("_r").cast("long"), F.lit(size - 1).cast("long"), F.least(F.col("_n"), F.lit(size).cast("long"))))
    return r.join(n, by).withColumn("position", F.explode(copies.cast("array<long>"))).drop("_r", "_n")


def passes(n: Column, size: int = 8192, least: int = 50, most: int = 1000) -> Column:
    """Inference passes over a plot of n points."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(3 * n / size))).cast("int")


def pass_blocks(points: DataFrame, n_passes: int, size: int, by: str = "plot", key: str = "point_id", seed: int = 42) -> DataFrame:
    """Pass p takes the ``size`` points of a plot with the least draw of (seed, p, key).

    A point is copied only into passes where its draw is below a share of the plot that holds
    ``size`` points or more but for once in 1e12 passes, so rows grow with passes times ``size``
    and not with passes times points; ranks settle the rest."""
    n = points.groupBy(by).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(size + 8 * math.sqrt(size) + 40) / F.col("_n"))
    taken = F.filter(F.sequence(F.lit(0), F.lit(n_passes - 1)), lambda p: draw(seed, p, by, key) < F.col("_share"))
    wide = points.join(n, by).withColumn("_share", share).withColumn("pass", F.explode(taken)).drop("_n", "_share")
    return wide.withColumn("_r", F.row_number().over(W.partitionBy(by, "pass").orderBy(draw(seed, "pass", by, key), key))).where(F.col("_r") <= size).drop("_r")


def augment(points: DataFrame, jitter: float = 0.02, low: float = 0.9, high: float = 1.1, by: str = "plot", key: str = "point_id", seed: int = 42) -> DataFrame:
    """Gaussian jitter per point; per plot a mirror of x with even chance and one scale."""
    scale, flip = F.lit(low) + draw(seed, F.lit("scale"), by) * (high - low), F.when(draw(seed, F.lit("flip"), by) < 0.5, -1.0).otherwise(1.0)
    moved = {a: (F.col(a) + normal(seed, F.lit(a), by, key) * jitter) * scale * (flip if a == "x" else 1.0) for a in ("x", "y", "z")}
    return points.withColumns(moved)


def bootstrap_index(b: Column, i: Column, n: Column, seed: int | Column = 42) -> Column:
    """A portable resampling index in [0, n) for draw i of resample b."""
    return F.floor(whole(F.lit(seed) if isinstance(seed, int) else seed, b, i) * n / F.lit(PRIME)).cast("int")


def block_normalised(points: DataFrame, by: str = "plot", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Coordinates about their group's centre, over the greatest distance from it."""
    mid = points.groupBy(by).agg(*[F.avg(a).alias(f"_{a}") for a in axes])
    centred = points.join(mid, by).withColumns({a: F.col(a) - F.col(f"_{a}") for a in axes}).drop(*[f"_{a}" for a in axes])
    size = F.sqrt(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0)))
    far = centred.groupBy(by).agg(F.max(size).alias("_far"))
    return centred.join(far, by).withColumns({a: F.col(a) / (F.col("_far") + 1e-8) for a in axes}).drop("_far")
