"""Overlap of predicted and true instances, and their one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.guards import ratio
from stemline.sources.shared import keep, release


def overlaps(points: DataFrame, by: str = "plot", pred: str = "pred_id", gt: str = "gt_id") -> DataFrame:
    """(by, pred_id, gt_id, inter, n_pred, n_gt, iou) of the pairs that share points.

    Ids from 1 count; a segment's size counts all its points, whatever their other id.  One pass
    counts points per pair; sizes follow from the counts, so no pair is compared that doesn't meet."""
    return cell_overlaps(points.groupBy(by, F.col(pred).alias("pred_id"), F.col(gt).alias("gt_id")).agg(F.count("*").alias("inter")), by)


def cell_overlaps(cells: DataFrame, by: str = "plot") -> DataFrame:
    """The same of counted cells (by, pred_id, gt_id, inter)."""
    n_pred = cells.where("pred_id > 0").groupBy(by, "pred_id").agg(F.sum("inter").alias("n_pred"))
    n_gt = cells.where("gt_id > 0").groupBy(by, "gt_id").agg(F.sum("inter").alias("n_gt"))
    pairs = cells.where("pred_id > 0 and gt_id > 0").join(n_pred, [by, "pred_id"]).join(n_gt, [by, "gt_id"])
    return pairs.select(by, "pred_id", "gt_id", "inter", "n_pred", "n_gt", ratio("inter", F.col("n_pred") + F.col("n_gt") - F.col("inter")).alias("iou"))


def matches(pairs: DataFrame, threshold: float = 0.5, by: str = "plot") -> DataFrame:
    """The pairs that greedy matching by falling overlap takes.

    Segments of one side are disjoint, so from a threshold of one half on a pair above it stands
    alone and only pairs at exactly one half compete, in stars: the lower predicted id, then the
    lower true id wins.  Below it pairs are taken in rounds: one that is first for both its ends, by falling overlap, predicted and
    true id, is what the greedy order takes of all pairs that touch it, so it is taken and its ends leave."""
    if threshold <= 0:
        raise ValueError("a threshold of 0 would match instances that don't overlap")
    able = pairs.where(F.col("iou") >= threshold)
    if threshold >= 0.5:
        return _mutual(able, by)
    left, taken = keep(able), []
    while not left.isEmpty():
        taken.append(keep(_mutual(left, by)))
        rest = left.join(taken[-1].select(by, "pred_id"), [by, "pred_id"], "left_anti").join(taken[-1].select(by, "gt_id"), [by, "gt_id"], "left_anti")
        done, left = left, keep(rest.select(able.columns))
        release(done)
    return reduce(DataFrame.unionByName, taken) if taken else left


def _mutual(pairs: DataFrame, by: str) -> DataFrame:
    """The pairs that come first for both their ends; an end's pairs are few, for segments that overlap it by a share are disjoint."""
    order = (F.desc("iou"), "pred_id", "gt_id")
    ranked = pairs.withColumn("_g", F.row_number().over(W.partitionBy(by, "gt_id").orderBy(*order))).withColumn("_p", F.row_number().over(W.partitionBy(by, "pred_id").orderBy(*order)))
    return ranked.where("_g = 1 and _p = 1").drop("_g", "_p")


def scores(points: DataFrame, threshold: float = 0.5, by: str = "plot", pred: str = "pred_id", gt: str = "gt_id") -> DataFrame:
    """One row per plot of TP, FP, FN, precision, recall, f1, coverage, counts, mean overlap and the two segmentation errors."""
    found = matches(overlaps(points, by, pred, gt), threshold, by)
    hit = found.groupBy(by).agg(F.count("*").alias("TP"), F.countDistinct("gt_id").alias("covered"), F.avg("iou").alias("mean_iou"))
    sizes = points.groupBy(by).agg(
        F.countDistinct(F.when(F.col(gt) > 0, F.col(gt))).alias("n_gt_trees"), F.countDistinct(F.when(F.col(pred) > 0, F.col(pred))).alias("n_pred_trees")
    )
    joined = sizes.join(hit, by, "left").withColumn("TP", F.coalesce("TP", F.lit(0)).cast("long"))
    joined = joined.withColumn("FP", F.col("n_pred_trees") - F.col("TP")).withColumn("FN", F.col("n_gt_trees") - F.col("TP"))
    p, r = ratio("TP", F.col("TP") + F.col("FP")), ratio("TP", F.col("TP") + F.col("FN"))
    return joined.select(
        by, "TP", "FP", "FN", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"),
        ratio(F.coalesce("covered", F.lit(0)), "n_gt_trees").alias("coverage"), "n_gt_trees", "n_pred_trees",
        F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou_matched"), ratio("FP", "n_gt_trees").alias("over_seg"), ratio("FN", "n_gt_trees").alias("under_seg"),
    )


def set_iou(a: Iterable[int] | Iterator[int], b: Iterable[int] | Iterator[int]) -> float:
    """Overlap of two sets of points over their union; 0 for two empty sets."""
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def array_iou(a: str, b: str) -> Column:
    """The same of two array columns."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
