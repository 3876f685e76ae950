"""Scores of point labels, coverage, banded histograms and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.guards import col, ratio


def _count(c: Column) -> Column:
    return F.count_if(c)


def confusion(points: DataFrame, by: list[str], gt: str = "label", pred: str = "semantic_pred") -> DataFrame:
    g, p = F.col(gt), F.col(pred)
    return points.where(g.isin(0, 1)).groupBy(*by).agg(
        _count((g == 1) & (p == 1)).alias("tp"), _count((g == 0) & (p == 1)).alias("fp"), _count((g == 1) & (p == 0)).alias("fn"), _count((g == 0) & (p == 0)).alias("tn"),
        _count(g == p).alias("right"), F.count("*").alias("n"),
    )


def metrics(points: DataFrame, by: list[str], gt: str = "label", pred: str = "semantic_pred") -> DataFrame:
    """Accuracy, overlap per class, their mean, F1 of trees and the number of points with a valid label.

    A prediction outside the two classes counts against accuracy and is in neither cell of the matrix."""
    c = confusion(points, by, gt, pred)
    iou_tree = F.col("tp") / F.greatest(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
    iou_other = F.col("tn") / F.greatest(F.col("tn") + F.col("fp") + F.col("fn"), F.lit(1))
    return c.select(
        *by, ratio("right", "n").alias("sem_accuracy"), iou_tree.alias("sem_iou_tree"), iou_other.alias("sem_iou_notree"), ((iou_tree + iou_other) / 2).alias("sem_miou"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("sem_seg_f1"), F.col("n").alias("sem_n_points_evaluated"),
    )


def batch_miou(points: DataFrame, by: list[str], gt: str = "label", pred: str = "semantic_pred", classes: int = 2) -> DataFrame:
    """Mean overlap over the classes that occur at all; null if none does."""
    g, p = F.col(gt), F.col(pred)
    counts = points.groupBy(*by).agg(*[x for k in range(classes) for x in (_count((g == k) & (p == k)).alias(f"i{k}"), _count((g == k) | (p == k)).alias(f"u{k}"))])
    each = F.array(*[ratio(f"i{k}", f"u{k}", None) for k in range(classes)])
    there = F.filter(each, lambda x: x.isNotNull())
    return counts.select(*by, ratio(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there), None).alias("miou"))


def normalised_confusion(points: DataFrame, gt: str = "label", pred: str = "semantic_pred") -> DataFrame:
    """(gt, pred, n, share of the gt row)."""
    cells = points.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(W.partitionBy("gt")), F.lit(1)))


def error_rates(points: DataFrame, by: list[str], gt: str = "label", pred: str = "semantic_pred") -> DataFrame:
    """Percent of valid points in error, and percent of false and missed trees and of trees over all points."""
    g, p = F.col(gt), F.col(pred)
    n = points.groupBy(*by).agg(_count((g == 0) & (p == 1)).alias("fp"), _count((g == 1) & (p == 0)).alias("fn"), _count(g.isin(0, 1)).alias("valid"), _count(g == 1).alias("trees"), F.count("*").alias("n"))
    return n.select(
        *by, (100 * (F.col("fp") + F.col("fn")) / F.greatest("valid", F.lit(1))).alias("error_pct"), ratio(100 * F.col("fp"), "n").alias("fp_pct"), ratio(100 * F.col("fn"), "n").alias("fn_pct"), ratio(100 * F.col("trees"), "n").alias("tree_pct")
    )


def class_weights(points: DataFrame, label: str = "label") -> DataFrame:
    """total / (2 * count) per class."""
    n = points.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    # one row per class
    return n.withColumn("weight", F.sum("n").over(W.partitionBy()) / (2 * F.col("n") + 1e-6))


def coverage(counts: DataFrame, by: list[str], count: str = "n_samples") -> DataFrame:
    n = counts.groupBy(*by).agg(F.count("*").alias("total"), _count(F.col(count) > 0).alias("covered"))
    return n.select(*by, "total", "covered", (F.col("total") - F.col("covered")).alias("uncovered"), ratio(100 * F.col("covered"), "total").alias("covered_pct"))


def merge_probabilities(samples: DataFrame, keys: list[str], p0: str = "p0", p1: str = "p1") -> DataFrame:
    """Mean of each point's sampled probabilities, how often it was sampled, and the class (0 on ties)."""
    s = samples.groupBy(*keys).agg(F.avg(p0).alias("p0"), F.avg(p1).alias("p1"), F.count("*").alias("n_samples"))
    return s.withColumn("semantic_pred", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0))


def banded(points: DataFrame, by: list[str], edges: list[float], value: str = "hag") -> DataFrame:
    """Counts per half-open band [edge, next edge), with the percent of all that fall in a band; what lies outside has none."""
    v = F.col(value)
    band = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        band = F.when((v >= edges[i]) & (v < edges[i + 1]), i).otherwise(band)
    n = points.withColumn("band", band).where("band is not null").groupBy(*by, "band").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def size_histogram(points: DataFrame, instance: str = "instance_id", by: str = "plot", bins: int = 19) -> DataFrame:
    """Sizes of instances (ids from 1) in equal bins between the least and the greatest size of all; the last bin is closed."""
    sizes = points.where(F.col(instance) > 0).groupBy(by, instance).agg(F.count("*").alias("size"))
    ends = sizes.agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("size") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))), F.lit(bins - 1))).otherwise(0)
    # the ends are one row
    return sizes.join(F.broadcast(ends)).withColumn("bin", b.cast("int")).groupBy("bin").agg(F.count("*").alias("n"))


def class_share(points: DataFrame, by: list[str], value: str) -> DataFrame:
    """Histogram of a code with percents."""
    n = points.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def is_tree(label: Column | str) -> Column:
    return col(label) == 1
