"""The five flows as one function of (filter, seeding), and the steps of the whole experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.config import DESIGN, Config, Watershed
from stemline.operators import gridsearch, labels, matching, raster, segment, semantic
from stemline.sources import tables


def prepare(points: DataFrame, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Raw points with scaled intensity, ``label`` and ``hag``."""
    t = cfg.terrain
    scaled = labels.scale_intensity(points).withColumn("label", labels.binary_label())
    return raster.heights(scaled, t.resolution, t.smooth_window, t.hag_min, t.hag_max)


def filtered(prepared: DataFrame, method: str, predictions: DataFrame | None, cfg: Config = Config(), require_valid: bool = True) -> DataFrame:  # noqa: B008
    """What a method segments: all valid points, or its predicted trees."""
    if DESIGN[method][0] == "none":
        return labels.valid(prepared)
    if predictions is None:
        raise ValueError(f"{method} needs predictions")
    joined = prepared.join(predictions.select("plot", "point_id", "semantic_pred"), ["plot", "point_id"])
    return labels.tree_points(joined, min_hag=cfg.terrain.min_tree_hag, require_valid=require_valid)


def instances(prepared: DataFrame, method: str, predictions: DataFrame | None = None, params: Watershed = Watershed(), cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """(method, plot, point_id, semantic_pred, instance_id) of all points."""
    found = segment.segment(filtered(prepared, method, predictions, cfg), DESIGN[method][1], params)
    whole = labels.scatter(prepared.select("plot", "point_id"), found, {"instance_id": 0})
    if predictions is None:
        whole = whole.withColumn("semantic_pred", F.lit(-1))
    else:
        whole = labels.scatter(whole, predictions, {"semantic_pred": -1})
    return whole.select(F.lit(method).alias("method"), "plot", "point_id", "semantic_pred", F.col("instance_id").cast("int").alias("instance_id"))


def score(prepared: DataFrame, found: DataFrame, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """One row of metrics per plot: instances on valid points, and the semantic ones where there are predictions."""
    method = DESIGN[found.select("method").first()[0]][0]
    joined = labels.valid(prepared.select("plot", "institution", "point_id", "label", "tree_id")).join(found, ["plot", "point_id"])
    named = joined.select("plot", "label", "semantic_pred", F.col("tree_id").alias("gt_id"), F.col("instance_id").alias("pred_id"))
    rows = prepared.select("plot", "institution").distinct().join(matching.scores(named, cfg.evaluation.iou_threshold), "plot")
    return rows if method == "none" else rows.join(semantic.metrics(named, ["plot"]), "plot", "left")


def tune(prepared: DataFrame, method: str, predictions: DataFrame | None = None, grid: dict | None = None, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(all combinations, best row) of a method's grid search on the points that it segments."""
    seeding = DESIGN[method][1]
    grid = grid or (gridsearch.GRID if seeding == "chm" else gridsearch.GRID_DENSITY)
    points = filtered(prepared, method, predictions, cfg).withColumn("gt_id", F.col("tree_id"))
    summary = gridsearch.summarise(gridsearch.score_plots(points, seeding, grid, cfg.watershed, cfg.evaluation.iou_threshold), grid)
    return summary, gridsearch.best(summary, method)


def run_stage(prepared: DataFrame, method: str, path: str, best: DataFrame | None, predictions: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """The instance stage with resume: plots that are stored already are not segmented again, but all are scored."""
    spark = prepared.sparkSession
    params = tables.best_params(best, method, cfg.watershed)
    todo = prepared
    if tables.exists(spark, path):
        done = tables.predictions(spark, path, method)
        todo = prepared.join(tables.missing_plots(prepared.select("plot").distinct(), done, method), "plot")
    tables.write_predictions(instances(todo, method, predictions, params, cfg), path)
    return score(prepared, tables.predictions(spark, path, method), cfg)
