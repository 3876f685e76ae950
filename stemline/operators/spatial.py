"""Rasters of instances and searches over squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.guards import cell


def last_point_raster(points: DataFrame, size: float, value: str, by: str = "plot", most: int = 4000) -> DataFrame:
    """(by, px, py, value): the value of the last point (greatest id) of each pixel; the grid is coarsened to ``most`` pixels, y points down."""
    box = points.groupBy(by).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    step = F.greatest(F.lit(float(size)), side / F.lit(float(most)))
    px, py = cell("x", "_x0", F.col("_s")), cell("y", "_y0", F.col("_s"))
    rows = cell("_y1", "_y0", F.col("_s"))
    placed = points.join(box.withColumn("_s", step), by).select(by, px.alias("px"), (rows - py).alias("py"), "point_id", F.col(value).alias("_v"))
    return placed.groupBy(by, "px", "py").agg(F.max(F.struct("point_id", "_v")).alias("m")).select(by, "px", "py", F.col("m._v").alias(value))


def majority_raster(points: DataFrame, size: float, instance: str = "instance_id", by: str = "plot") -> DataFrame:
    """(by, px, py, instance, n): the instance with most points in each cell of a grid over all points, whose last cells take the far edge; ties go to the larger instance, then the lower id."""
    some = points.where(F.col(instance) > 0)
    last = lambda v: F.greatest(F.lit(1), F.ceil((F.max(v) - F.min(v)) / size)) - 1
    box = points.groupBy(by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), last("x").alias("_lx"), last("y").alias("_ly"))
    inside = lambda v, o, most: F.least(cell(v, o, size), F.col(most)).cast("long")
    n = some.join(box, by).groupBy(by, inside("x", "_x0", "_lx").alias("px"), inside("y", "_y0", "_ly").alias("py"), instance).agg(F.count("*").alias("n"))
    sizes = some.groupBy(by, instance).agg(F.count("*").alias("_size"))
    order = W.partitionBy(by, "px", "py").orderBy(F.desc("n"), F.desc("_size"), instance)
    return n.join(sizes, [by, instance]).withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, "px", "py", instance, "n")


def densest_zone(points: DataFrame, gt: str = "gt_id", half: float = 10.0, reach: float = 50.0, step: float = 10.0, by: str = "plot") -> DataFrame:
    """(by, cx, cy, n_trees): the window with most distinct trees among those around each plot's middle; the first of equals.

    Centres lie on a lattice, so a point names the few windows it is in by arithmetic; no pairs of points and
    centres are made beyond those."""
    side = int(reach / step)
    mid = points.groupBy(by).agg(((F.min("x") + F.max("x")) / 2).alias("_mx"), ((F.min("y") + F.max("y")) / 2).alias("_my"))
    rel = lambda v, m: (F.col(v) - F.col(m)) / step
    span = half / step
    lattice = lambda r: F.filter(F.sequence(F.greatest(F.floor(r - span), F.lit(-side)), F.greatest(F.least(F.ceil(r + span), F.lit(side)), F.greatest(F.floor(r - span), F.lit(-side)))), lambda k: (F.abs(k * step - r * step) < half) & (k >= -side) & (k <= side))
    trees = points.where(F.col(gt) > 0).join(mid, by)
    wide = trees.withColumn("_i", F.explode(lattice(rel("x", "_mx")))).withColumn("_j", F.explode(lattice(rel("y", "_my"))))
    n = wide.groupBy(by, "_i", "_j").agg(F.countDistinct(gt).alias("n_trees"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"))
    first = W.partitionBy(by).orderBy(F.desc("n_trees"), "_i", "_j")
    best = n.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return best.select(by, (F.col("_mx") + F.col("_i") * step).alias("cx"), (F.col("_my") + F.col("_j") * step).alias("cy"), "n_trees")


def merged_trees(points: DataFrame, least: int = 3, pred: str = "pred_id", gt: str = "gt_id", by: str = "plot") -> DataFrame:
    """Predicted segments that hold ``least`` distinct true ids or more (0 counts), with their centroids."""
    return points.where(F.col(pred) > 0).groupBy(by, pred).agg(F.countDistinct(gt).alias("n_gt"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).where(F.col("n_gt") >= least)
