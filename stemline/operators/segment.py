"""Instance segmentation of voxelised plots: seeds from a surface, then a spanning forest of the density.

All is keyed by the plot and none of it is done plot by plot: points are counted by voxel, the density is a sparse
filter, seeds are found on square tiles of the surface, and labels come from ``forest``.  Order is
explicit where it matters: peaks by (value falling, i, j), faces by their densities and ids; smoothed values are
compared to nine digits, so that ties don't hang on the order of sums.  Border voxels may therefore fall to another seed than
in libraries that leave this open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.config import Watershed
from stemline.operators import voxel
from stemline.operators.forest import dealt, spanning_labels
from stemline.sources.shared import keep, release

SEEDINGS = ("chm", "density")
DIGITS = 9


def sliding_max(grid: np.ndarray, d: int) -> np.ndarray:
    """Greatest value of the square of half-width d around each cell."""
    out = grid
    for axis in (0, 1):
        padded = np.pad(out, [(d, d) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        n = out.shape[axis]
        out = np.max([np.take(padded, np.arange(k, k + n), axis=axis) for k in range(2 * d + 1)], axis=0)
    return out


def _tile_peaks(surface: DataFrame, threshold: float, by: str, tile: int) -> DataFrame:
    """(by, vi, vj, s, state): local maxima; state 1 is a peak, null one that peaks of other tiles may suppress; suppressed ones have no row.

    A tile sees a halo of 2 d cells, so that the maxima within d of its own are known too."""
    if threshold < 0:
        raise ValueError("cells that a sparse surface doesn't have count as 0, so a peak's threshold is 0 at least")
    kind = surface.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby([by, "_ti", "_tj"], sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        first = np.searchsorted(group[order], np.arange(group.max() + 2))
        columns = [pdf[c].to_numpy()[order] for c in (by, "d", "vi", "vj", "s", "own")]
        found = [f for k in range(len(first) - 1) for f in tile_of(*[c[first[k] : first[k + 1]] for c in columns])]
        return pd.DataFrame(found, columns=[by, "d", "vi", "vj", "s", "state"]).astype({"d": "int32", "vi": "int32", "vj": "int32", "s": "float64", "state": "Int32"})

    def tile_of(name: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, own: np.ndarray) -> list[tuple]:
        d, i0, j0 = int(width[0]), i.min(), j.min()
        grid = np.full((int(np.ptp(i)) + 1, int(np.ptp(j)) + 1), -np.inf)
        inside = np.zeros(grid.shape, bool)
        grid[i - i0, j - j0], inside[i - i0, j - j0] = s, own
        a, b = np.nonzero((grid == sliding_max(grid, d)) & (grid > threshold))
        order = np.lexsort((b, a, -grid[a, b]))
        state = np.zeros(grid.shape, np.int8)  # 1 a peak, 2 open
        found = []
        for p, q in zip(a[order].tolist(), b[order].tolist(), strict=True):
            near = state[max(0, p - d) : p + d + 1, max(0, q - d) : q + d + 1]
            if not inside[p, q]:
                state[p, q] = 2
            elif not (near == 1).any():
                state[p, q] = 2 if (near == 2).any() else 1
                found.append((name[0], d, p + i0, q + j0, grid[p, q], 1 if state[p, q] == 1 else None))
        return found

    reach = lambda c: F.sequence(F.floor((F.col(c) - 2 * F.col("d")) / tile), F.floor((F.col(c) + 2 * F.col("d")) / tile))
    spread = surface.select(by, "d", "vi", "vj", "s").withColumn("_ti", F.explode(reach("vi"))).withColumn("_tj", F.explode(reach("vj")))
    own = (F.floor(F.col("vi") / tile) == F.col("_ti")) & (F.floor(F.col("vj") / tile) == F.col("_tj"))
    return dealt(spread.withColumn("own", own), by, surface.count()).applyInPandas(one, f"`{by}` {kind}, d int, vi int, vj int, s double, state int")


def peaks(surface: DataFrame, threshold: float, by: str = "plot", tile: int = 128) -> DataFrame:
    """(by, vi, vj, s): local maxima above the threshold of a surface (by, vi, vj, s, d), d the half-width of the square, one for all of ``by``.

    Maxima within d of each other are equal; of them the first in (i, j) order stays that no earlier one suppresses.
    Tiles settle all but what hangs on maxima of other tiles.  Those are settled in rounds: a maximum with a peak before it goes, one with nothing open before it is a peak."""
    surface = keep(surface.select(by, "vi", "vj", "s", "d"))
    at = keep(_tile_peaks(surface, threshold, by, tile))
    release(surface)
    d = F.col("d")
    while not (waiting := at.where("state IS NULL")).isEmpty():
        bins = lambda c, spread: F.explode(F.array(*[F.floor(F.col(c) / (d + 1)) + o for o in spread]))
        left = waiting.withColumn("_bi", bins("vi", (-1, 0, 1))).withColumn("_bj", bins("vj", (-1, 0, 1)))
        right = at.select(by, F.col("vi").alias("i"), F.col("vj").alias("j"), F.coalesce("state", F.lit(2)).alias("of"), F.floor(F.col("vi") / (d + 1)).alias("_bi"), F.floor(F.col("vj") / (d + 1)).alias("_bj"))
        before = (F.col("i") < F.col("vi")) | ((F.col("i") == F.col("vi")) & (F.col("j") < F.col("vj")))
        close = (F.abs(F.col("i") - F.col("vi")) <= d) & (F.abs(F.col("j") - F.col("vj")) <= d)
        met = left.join(right, [by, "_bi", "_bj"]).where(close & before).groupBy(by, "vi", "vj").agg(F.max(F.col("of") == 1).alias("_out"), F.max(F.col("of") == 2).alias("_wait"))
        judged = at.join(met, [by, "vi", "vj"], "left").where(~((F.col("state").isNull()) & F.coalesce("_out", F.lit(False))))
        state = F.when(F.col("state").isNull() & F.coalesce("_wait", F.lit(False)), F.lit(None).cast("int")).otherwise(1)
        done, at = at, keep(judged.select(by, "d", "vi", "vj", "s", state.alias("state")))
        release(done)
    return at.select(by, "vi", "vj", "s")


def density_of(volume: DataFrame) -> DataFrame:
    return volume.withColumn("density", F.round("density", DIGITS))


def half_width(radius: float, size: float) -> int:
    return max(1, int(radius / size))


def column_sums(volume: DataFrame, top: DataFrame, by: str) -> DataFrame:
    """(by, vi, vj, s): the density from each column's top down to ``band`` voxels below it."""
    inside = (F.col("vk") <= F.col("top_k")) & (F.col("vk") >= F.greatest(F.col("top_k") - F.col("band"), F.lit(0)))
    return volume.join(top, [by, "vi", "vj"]).where(inside).groupBy(by, "vi", "vj").agg(F.sum("density").alias("s"))


def numbered(found: DataFrame, by: str) -> DataFrame:
    """Markers from 1 by falling surface, at the top voxels (top_k) of their columns; a plot has a row a tree here."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("s"), "vi", "vj"))
    return found.select(by, rank.cast("int").alias("marker"), "vi", "vj", F.col("top_k").cast("int").alias("vk"))


def seeds(voxels: DataFrame, seeding: str = "chm", params: Watershed = Watershed(), by: str = "plot", volume: DataFrame | None = None, tile: int = 128) -> DataFrame:  # noqa: B008
    """(by, marker, vi, vj, vk): seeds numbered from 1 by falling surface, at the top voxels of their columns.

    ``volume`` is the smoothed density if it is there already; only density seeding needs it."""
    if seeding not in SEEDINGS:
        raise ValueError(f"seeding is one of {SEEDINGS}")
    d = F.lit(half_width(params.min_crown_radius_m, params.voxel_size))
    top = voxel.canopy(voxels, params.voxel_size, by)
    high = F.col("top_k") * F.lit(float(params.voxel_size)) >= F.lit(float(params.min_tree_height))
    if seeding == "chm":
        found = peaks(top.select(by, "vi", "vj", F.col("chm_m").cast("double").alias("s"), d.alias("d")), params.min_tree_height, by, tile).join(top.drop("chm_m"), [by, "vi", "vj"])
    else:
        volume = density_of(voxel.smooth(voxels, params.gaussian_sigma, by)) if volume is None else volume
        column = column_sums(volume, top.withColumn("band", F.lit(voxel.band_voxels(params.top_band_m, params.voxel_size))), by)
        raised = voxel.smooth(column, params.gaussian_sigma, by, "s", ("vi", "vj")).select(by, "vi", "vj", F.round("density", DIGITS).alias("s"))
        found = peaks(raised.withColumn("d", d), 0.0, by, tile).join(top.drop("chm_m"), [by, "vi", "vj"]).where(high)
    return numbered(found, by)


def label_voxels(voxels: DataFrame, seeding: str = "chm", params: Watershed = Watershed(), by: str = "plot", tile: int = 64) -> DataFrame:  # noqa: B008
    """(by, vi, vj, vk, label) of occupied voxels; 0 where no seed reaches."""
    volume = keep(density_of(voxel.smooth(voxels, params.gaussian_sigma, by)))
    marked = seeds(voxels, seeding, params, by, volume)
    place = [by, "vi", "vj", "vk"]
    return spanning_labels(voxels.select(place).join(volume.select(*place, F.col("density").alias("d")), place).join(marked, place, "left"), by, tile)


def segment(points: DataFrame, seeding: str = "chm", params: Watershed = Watershed(), by: str = "plot", axes: tuple[str, str, str] = ("x", "y", "hag")) -> DataFrame:  # noqa: B008
    """``points`` with ``instance_id``: seeds numbered from 1 per plot, 0 for none; ids of dropped segments leave gaps."""
    placed = voxel.voxelise(points, params.voxel_size, by, axes)
    labels = label_voxels(keep(voxel.counts(placed, by)), seeding, params, by)
    joined = voxel.label_points(placed, labels, by).drop("vi", "vj", "vk")
    return voxel.drop_small(joined, params.min_points_per_tree, by)
