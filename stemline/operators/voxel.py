"""Sparse voxel grids: counts, canopy heights, density surfaces and the way back to points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.operators.raster import spread


def voxelise(points: DataFrame, size: float, by: str = "plot", axes: tuple[str, str, str] = ("x", "y", "h")) -> DataFrame:
    """``points`` with (vi, vj, vk) from the least coordinates of their plot.

    The origin is an aggregate that is combined before its shuffle, joined back by plot."""
    origin = points.groupBy(by).agg(*[F.min(a).cast("double").alias(f"_{a}0") for a in axes])
    index = lambda a: F.floor((F.col(a).cast("double") - F.col(f"_{a}0")) / F.lit(float(size))).cast("int")
    placed = points.join(origin, by)
    return placed.withColumns({v: index(a) for v, a in zip(("vi", "vj", "vk"), axes, strict=True)}).drop(*[f"_{a}0" for a in axes])


def counts(voxelised: DataFrame, by: str = "plot") -> DataFrame:
    return voxelised.groupBy(by, "vi", "vj", "vk").agg(F.count("*").alias("n"))


def canopy(voxels: DataFrame, size: float, by: str = "plot") -> DataFrame:
    """(by, vi, vj, top_k, chm_m): the highest occupied voxel of each column, in metres as float."""
    top = voxels.groupBy(by, "vi", "vj").agg(F.max("vk").alias("top_k"))
    return top.withColumn("chm_m", (F.col("top_k") * F.lit(float(size))).cast("float"))


def band_voxels(band: float, size: float) -> int:
    return max(1, int(band / size))


def top_band(voxels: DataFrame, band: int, by: str = "plot", value: str = "n") -> DataFrame:
    """(by, vi, vj, top_k, surface): the sum over the top voxel and the ``band`` below it, both included."""
    top = canopy(voxels, 1.0, by).drop("chm_m")
    inside = F.col("vk") >= F.greatest(F.col("top_k") - band, F.lit(0))
    return voxels.join(top, [by, "vi", "vj"]).where(inside).groupBy(by, "vi", "vj", "top_k").agg(F.sum(value).alias("surface"))


def smooth(voxels: DataFrame, sigma: float, by: str = "plot", value: str = "n", axes: tuple[str, ...] = ("vi", "vj", "vk")) -> DataFrame:
    """Sparse gaussian filter in space, or of a surface over two axes: (by, axes, density) of all cells within reach."""
    return spread(voxels.select(by, *axes, F.col(value).alias("density")), sigma, axes, "density", by)


def label_points(voxelised: DataFrame, labels: DataFrame, by: str = "plot") -> DataFrame:
    """``voxelised`` points with the ``instance_id`` of their voxel, 0 where it has none."""
    return voxelised.join(labels.select(by, "vi", "vj", "vk", F.col("label").alias("_label")), [by, "vi", "vj", "vk"], "left").withColumn("instance_id", F.coalesce("_label", F.lit(0))).drop("_label")


def drop_small(points: DataFrame, least: int, by: str = "plot", instance: str = "instance_id") -> DataFrame:
    """Ids of segments with fewer points become 0; the others keep theirs."""
    small = points.where(F.col(instance) > 0).groupBy(by, instance).agg(F.count("*").alias("_n")).where(F.col("_n") < least).drop("_n").withColumn("_small", F.lit(True))
    return points.join(small, [by, instance], "left").withColumn(instance, F.when(F.col("_small"), 0).otherwise(F.col(instance))).drop("_small").select(*points.columns)


def running_density(voxels: DataFrame, by: str = "plot") -> DataFrame:
    """Running sum of counts up each column; a column is bounded by the height of the box."""
    from pyspark.sql import Window as W

    up = W.partitionBy(by, "vi", "vj").orderBy("vk").rowsBetween(W.unboundedPreceding, W.currentRow)
    return voxels.withColumn("cumulative", F.sum("n").over(up))
