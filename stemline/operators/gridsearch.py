"""Search over segmentation parameters: every plot is voxelised once per size, every combination scored.

A combination of a plot is a run.  All runs go through the same tables: counts by voxel and true instance per (plot, size), a
smoothed volume per (plot, size, sigma), seeds and labels per run.  Nothing is done run by run or plot by plot, so a
search over many plots is one job per step, and a run's rows are its plot's voxels, not its points."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemline.config import Watershed
from stemline.functions.guards import ratio
from stemline.operators import matching, report, segment, voxel
from stemline.operators.forest import spanning_labels
from stemline.sources.shared import keep, release

#: The searched parameters of both seedings.
GRID = {"voxel_size": (0.1, 0.2, 0.3), "gaussian_sigma": (0.3, 0.5, 1.0), "min_crown_radius_m": (0.5, 1.0, 1.5, 2.0)}
GRID_DENSITY = {**GRID, "top_band_m": (2.0, 3.0, 5.0)}


def combinations(grid: dict[str, tuple[float, ...]]) -> list[dict[str, float]]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def voxel_tables(points: DataFrame, sizes: list[float], by: str = "plot", axes: tuple[str, str, str] = ("x", "y", "hag")) -> DataFrame:
    """(by, size, vi, vj, vk, gt_id, n): points counted by voxel of each size and by true instance."""
    origin = points.groupBy(by).agg(*[F.min(a).cast("double").alias(f"_{a}") for a in axes])
    wide = points.join(origin, by).withColumn("size", F.explode(F.array(*[F.lit(float(x)) for x in sizes])))
    index = lambda a: F.floor((F.col(a).cast("double") - F.col(f"_{a}")) / F.col("size")).cast("int")
    return wide.groupBy(by, "size", *[index(a).alias(v) for v, a in zip(("vi", "vj", "vk"), axes, strict=True)], "gt_id").agg(F.count("*").alias("n"))


def _smoothed(rows: DataFrame, sigmas: list[float], key: str, value: str, axes: tuple[str, ...]) -> DataFrame:
    """``rows`` (key, sigma, axes, value) filtered each with its sigma, to nine digits."""
    parts = [voxel.smooth(rows.where(F.col("sigma") == s), s, key, value, axes) for s in sigmas]
    return segment.density_of(reduce(DataFrame.unionByName, parts))


def label_runs(counts: DataFrame, seeding: str, combos: list[dict[str, float]], base: Watershed = Watershed(), by: str = "plot") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """((run, vi, vj, vk, label), (run, combo, by, size)) of voxel counts (by, size, vi, vj, vk, n) under all combinations."""
    params = [base.__dict__ | c for c in combos]
    settings = [(i, float(p["voxel_size"]), float(p["gaussian_sigma"]), segment.half_width(p["min_crown_radius_m"], p["voxel_size"]), voxel.band_voxels(p["top_band_m"], p["voxel_size"])) for i, p in enumerate(params)]
    spark, sigmas = counts.sparkSession, sorted({s[2] for s in settings})
    named = lambda *parts: F.concat_ws("|", *[F.col(c).cast("string") for c in parts])
    plots = counts.select(by, "size").distinct()
    # one row per combination
    runs = plots.join(F.broadcast(spark.createDataFrame(settings, "combo int, size double, sigma double, d int, band int")), "size")
    runs = keep(runs.select(named("combo", by).alias("run"), named("size", "sigma", by).alias("vol"), named("band", "size", "sigma", by).alias("col"), "combo", by, "size", "sigma", "d", "band"))
    of_size = lambda df: df.join(runs.select(by, "size", "vol", "sigma").distinct(), [by, "size"])
    occupied = keep(of_size(counts).select("vol", "sigma", "vi", "vj", "vk", "n"))
    volume = keep(_smoothed(occupied, sigmas, "vol", "n", ("vi", "vj", "vk")))
    tops = keep(counts.groupBy(by, "size", "vi", "vj").agg(F.max("vk").alias("top_k")))
    top_of_run = tops.join(runs.select("run", by, "size", "d"), [by, "size"]).withColumn("chm", (F.col("top_k") * F.col("size")).cast("float").cast("double"))
    if seeding == "chm":
        surface, threshold = top_of_run.select("run", "d", "vi", "vj", F.col("chm").alias("s")), base.min_tree_height
    else:
        columns = runs.select("col", "vol", by, "size", "sigma", "band").distinct()
        sums = segment.column_sums(volume.join(columns.select("vol", "col"), "vol").drop("vol"), tops.join(columns.select(by, "size", "col", "band"), [by, "size"]).select("col", "vi", "vj", "top_k", "band"), "col")
        raised = _smoothed(sums.join(columns.select("col", "sigma"), "col"), sigmas, "col", "s", ("vi", "vj"))
        surface, threshold = raised.join(runs.select("run", "col", "d"), "col").select("run", "d", "vi", "vj", F.col("density").alias("s")), 0.0
    found = segment.peaks(surface, threshold, "run").join(top_of_run.select("run", "vi", "vj", "top_k", "size"), ["run", "vi", "vj"])
    if seeding != "chm":
        found = found.where(F.col("top_k") * F.col("size") >= F.lit(float(base.min_tree_height)))
    place = ["run", "vi", "vj", "vk"]
    dense = volume.join(occupied.select("vol", "vi", "vj", "vk"), ["vol", "vi", "vj", "vk"]).join(runs.select("vol", "run"), "vol").select(*place, F.col("density").alias("d"))
    labels = spanning_labels(dense.join(segment.numbered(found, "run"), place, "left"), "run")
    return labels, runs.select("run", "combo", by, "size")


def score_plots(points: DataFrame, seeding: str, grid: dict[str, tuple[float, ...]], base: Watershed = Watershed(), threshold: float = 0.5, by: str = "plot", axes: tuple[str, str, str] = ("x", "y", "hag")) -> DataFrame:  # noqa: B008
    """(by, combo, f1) of every plot and combination: ``points`` are the filtered points with gt_id."""
    combos = combinations(grid)
    tables = keep(voxel_tables(points, sorted({float(c["voxel_size"]) for c in combos}), by, axes))
    counts = tables.groupBy(by, "size", "vi", "vj", "vk").agg(F.sum("n").alias("n"))
    labels, runs = label_runs(counts, seeding, combos, base, by)
    voxels = labels.join(runs, "run").join(tables, [by, "size", "vi", "vj", "vk"])
    cells = voxels.groupBy("run", "label", "gt_id").agg(F.sum("n").alias("inter"))
    small = cells.groupBy("run", "label").agg((F.sum("inter") < base.min_points_per_tree).alias("small"))
    # what is left of small segments belongs to none
    pred = F.when(F.col("small"), 0).otherwise(F.col("label"))
    cells = keep(cells.join(small, ["run", "label"]).groupBy("run", pred.alias("pred_id"), "gt_id").agg(F.sum("inter").alias("inter")))
    hit = matching.matches(matching.cell_overlaps(cells, "run"), threshold, "run").groupBy("run").agg(F.count("*").alias("tp"))
    ids = lambda c: F.count_distinct(F.when(F.col(c) > 0, F.col(c)))
    sizes = cells.groupBy("run").agg((ids("pred_id") + ids("gt_id")).alias("n"))
    f1: Column = ratio(2 * F.coalesce("tp", F.lit(0)), "n")
    scored = keep(runs.join(sizes, "run").join(hit, "run", "left").select(by, F.col("combo").cast("long").alias("combo"), f1.cast("double").alias("f1")))
    release(tables, cells)
    return scored


def summarise(scored: DataFrame, grid: dict[str, tuple[float, ...]]) -> DataFrame:
    """Parameters, mean_f1, std_f1 (population) and n_plots of each combination, best first."""
    rows = [(i, *map(float, c.values())) for i, c in enumerate(combinations(grid))]
    params = scored.sparkSession.createDataFrame(rows, "combo long, " + ", ".join(f"{n} double" for n in grid))
    s = scored.groupBy("combo").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count("f1").alias("n_plots"))
    return params.join(s, "combo").orderBy(F.desc("mean_f1"), "combo")


def best(summary: DataFrame, method: str) -> DataFrame:
    """The first combination with the greatest mean, as a row of the best-parameter table."""
    top = report.first_best(summary, "mean_f1", ["combo"])
    band = F.col("top_band_m") if "top_band_m" in summary.columns else F.lit(None).cast("double")
    return top.select(F.lit(method).alias("method"), "voxel_size", "gaussian_sigma", "min_crown_radius_m", band.alias("top_band_m"), "mean_f1")
