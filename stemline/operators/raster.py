"""Terrain surfaces and heights above ground, all relational: no plot meets one task.

Empty cells are interpolated over the triangles of the filled ones (``triangles.fill``), or by the cheaper
rule of ``fill``: an empty cell takes the inverse-distance mean of the
linear interpolations along its row and its column between the nearest filled cells (the nearest
one alone at the ends), and what then is left takes the nearest filled cell of all, the first in
(iy, ix) order of equals.  Both reproduce planes where a cell is bracketed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.guards import clamp
from stemline.operators import triangles
from stemline.operators.neighbors import nearest_of


def extents(points: DataFrame, resolution: float, by: str = "plot") -> DataFrame:
    """(by, x0, y0, z0, nx, ny) of the grid over all points; at least one cell."""
    e = points.groupBy(by).agg(F.min("x").cast("double").alias("x0"), F.max("x").cast("double").alias("x1"), F.min("y").cast("double").alias("y0"), F.max("y").cast("double").alias("y1"), F.min("z").cast("double").alias("z0"))
    cells = lambda lo, hi: F.greatest(F.ceil((F.col(hi) + resolution - F.col(lo)) / resolution) - 1, F.lit(1)).cast("long")
    return e.select(by, "x0", "y0", "z0", cells("x0", "x1").alias("nx"), cells("y0", "y1").alias("ny"))


def ground_cells(points: DataFrame, resolution: float = 0.5, by: str = "plot", code: int = 2) -> DataFrame:
    """(by, ix, iy, z): the exact median ground height per cell; a plot without ground raises when it is computed."""
    grid = extents(points, resolution, by)
    i = lambda v, o, n: F.least(F.greatest(F.floor((F.col(v) - F.col(o)) / resolution), F.lit(0)), F.col(n) - 1).cast("long")
    ground = points.where(F.col("classification") == code).join(grid, by)
    return ground.groupBy(by, i("x", "x0", "nx").alias("ix"), i("y", "y0", "ny").alias("iy")).agg(F.median("z").alias("z"))


def _line(cells: DataFrame, by: str, along: str, across: str, name: str) -> DataFrame:
    """``cells`` with ``name``: struct<v, w> of the interpolation of z along one axis and the inverse distance to the nearer value."""
    here = W.partitionBy(by, across).orderBy(along)
    known = F.when(F.col("z").isNotNull(), F.struct(F.col(along).alias("at"), "z"))
    before, after = F.last(known, True).over(here.rowsBetween(W.unboundedPreceding, 0)), F.first(known, True).over(here.rowsBetween(0, W.unboundedFollowing))
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col(along)
    between = lo["z"] + F.try_divide((hi["z"] - lo["z"]) * (x - lo["at"]), hi["at"] - lo["at"])
    value = F.coalesce(F.when(lo["at"] == hi["at"], lo["z"]).otherwise(between), lo["z"], hi["z"])
    near = F.least(x - lo["at"], hi["at"] - x)
    both = F.struct(value.alias("v"), F.when(value.isNotNull(), 1.0 / F.greatest(near, F.lit(0.5))).otherwise(0.0).alias("w"))
    return cells.withColumn("_lo", before).withColumn("_hi", after).withColumn(name, both).drop("_lo", "_hi")


def fill(cells: DataFrame, by: str = "plot") -> DataFrame:
    """(by, ix, iy, z) without nulls in z, of all cells (by, ix, iy, z) of grids that have a value.

    Rows and columns are windows, each a line of the grid; the last resort is a search outward from
    the cells that neither line reaches."""
    lined = _line(_line(cells, by, "ix", "iy", "_r"), by, "iy", "ix", "_c")
    weight = F.col("_r.w") + F.col("_c.w")
    mean = F.try_divide(F.coalesce(F.col("_r.v"), F.lit(0.0)) * F.col("_r.w") + F.coalesce(F.col("_c.v"), F.lit(0.0)) * F.col("_c.w"), weight)
    out = lined.select(by, "ix", "iy", "z", F.coalesce("z", mean).alias("filled"))
    # places in (iy, ix) order settle ties
    placed = out.select(by, F.struct("iy", "ix").alias("id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "z", "filled")
    bare, known = placed.where("filled is null"), placed.where("z is not null")
    if bare.isEmpty():
        return out.select(by, "ix", "iy", F.col("filled").alias("z"))
    near = nearest_of(bare, known, 1, 4.0, ("x", "y"), by, "id").select(by, "id", "other")
    last = near.join(known.select(by, F.col("id").alias("other"), "z"), [by, "other"]).select(by, "id.ix", "id.iy", "z")
    return out.where("filled is not null").select(by, "ix", "iy", F.col("filled").alias("z")).unionByName(last)


def kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def smooth(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter along every axis; borders are mirrored with their edge cell repeated."""
    if sigma <= 0:
        return grid.astype(float)
    w = kernel(sigma)
    r = len(w) // 2
    out = grid.astype(float)
    for axis in range(grid.ndim):
        n = out.shape[axis]
        at = np.arange(-r, n + r) % (2 * n)
        padded = np.take(out, np.where(at < n, at, 2 * n - 1 - at), axis=axis)
        out = sum(w[k] * np.take(padded, np.arange(k, k + n), axis=axis) for k in range(len(w)))
    return out


def spread(cells: DataFrame, sigma: float, axes: tuple[str, ...], value: str, by: str = "plot") -> DataFrame:
    """Gaussian filter of a sparse grid from 0 to its greatest indices: (by, axes, value) of all cells within reach, borders mirrored.

    Each cell gives its weighted share to its neighbours axis by axis, so it makes 2r + 1 rows an
    axis, and shares are summed before they are shuffled."""
    out = cells.select(by, *axes, F.col(value).cast("double").alias(value))
    if sigma <= 0:
        return out
    w = kernel(sigma)
    r = len(w) // 2
    out = out.join(cells.groupBy(by).agg(*[(F.max(a) + 1).alias(f"_n_{a}") for a in axes]), by)
    weights = F.array(*[F.struct(F.lit(k - r).alias("o"), F.lit(float(x)).alias("w")) for k, x in enumerate(w)])
    for axis in axes:
        # a mirrored border sends a cell's share to each cell whose mirrored reach meets it
        n = F.col(f"_n_{axis}")
        wide = out.withColumn("_x", F.explode(weights)).withColumn("_t", F.pmod(F.col(axis) + F.col("_x.o"), 2 * n))
        target = F.when(F.col("_t") < n, F.col("_t")).otherwise(2 * n - 1 - F.col("_t")).cast(cells.schema[axis].dataType)
        keys = [by, *[target.alias(a) if a == axis else F.col(a) for a in axes], *[f"_n_{a}" for a in axes]]
        out = wide.groupBy(*keys).agg(F.sum(F.col(value) * F.col("_x.w")).alias(value))
    return out.select(by, *axes, value)


#: how empty cells are filled
FILLS = {"triangles": triangles.fill, "lines": fill}


def dense_cells(points: DataFrame, resolution: float = 0.5, by: str = "plot") -> DataFrame:
    """(by, ix, iy, z) of every cell of every plot's grid, z null where a cell has no ground; a plot without ground raises when it is computed."""
    grid = extents(points, resolution, by)
    ground = ground_cells(points, resolution, by)
    some = ground.groupBy(by).agg(F.count("*").alias("_ground"))
    missing = F.raise_error(F.concat(F.lit("plot "), F.col(by).cast("string"), F.lit(" has no ground points")))
    # the check is part of a column that every row needs, so that it is not optimised away
    checked = grid.join(some, by, "left").withColumn("ny", F.when(F.col("_ground").isNull(), missing.cast("long")).otherwise(F.col("ny")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dense = checked.withColumn("iy", F.explode(upto("ny"))).withColumn("ix", F.explode(upto("nx"))).select(by, "ix", "iy")
    return dense.join(ground, [by, "ix", "iy"], "left")


def surface(points: DataFrame, resolution: float = 0.5, smooth_window: int = 5, by: str = "plot", gaps: str = "triangles") -> DataFrame:
    """One row per cell with the heights at its own and the three next centres, filled and smoothed; ``gaps`` names the fill."""
    z = spread(FILLS[gaps](dense_cells(points, resolution, by), by), smooth_window / 2, ("iy", "ix"), "z", by)
    ahead = lambda v, along, across: F.coalesce(F.lead(v).over(W.partitionBy(by, across).orderBy(along)), F.col(v))
    corners: dict[str, Column] = {"z10": ahead("z", "ix", "iy")}
    out = z.withColumns(corners).withColumns({"z01": ahead("z", "iy", "ix"), "z11": ahead("z10", "iy", "ix")})
    return out.select(by, "ix", "iy", F.col("z").alias("z00"), "z10", "z01", "z11")


def bilinear(points: DataFrame, cells: DataFrame, grid: DataFrame, resolution: float, by: str = "plot") -> DataFrame:
    """``points`` with ``ground``: the surface at cell centres, interpolated, and extrapolated past the outer ones.

    One equi-join on (by, ix, iy): each cell row has its four corners."""
    fx, fy = (F.col("x") - F.col("x0")) / resolution - 0.5, (F.col("y") - F.col("y0")) / resolution - 0.5
    low = lambda f, n: F.greatest(F.least(F.floor(f), F.col(n) - 2), F.lit(0)).cast("long")
    placed = points.join(grid.select(by, "x0", "y0", "nx", "ny"), by).withColumn("ix", low(fx, "nx")).withColumn("iy", low(fy, "ny"))
    placed = placed.withColumn("_tx", fx - F.col("ix")).withColumn("_ty", fy - F.col("iy"))
    joined = placed.join(cells, [by, "ix", "iy"])
    tx, ty = F.col("_tx"), F.col("_ty")
    ground = F.col("z00") * (1 - tx) * (1 - ty) + F.col("z10") * tx * (1 - ty) + F.col("z01") * (1 - tx) * ty + F.col("z11") * tx * ty
    return joined.withColumn("ground", ground).drop("x0", "y0", "nx", "ny", "ix", "iy", "_tx", "_ty", "z00", "z10", "z01", "z11")


def heights(points: DataFrame, resolution: float = 0.5, smooth_window: int = 5, low: float = 0.0, high: float = 50.0, by: str = "plot") -> DataFrame:
    """``points`` with ``hag``: height above the terrain, clamped, as float."""
    on = bilinear(points, surface(points, resolution, smooth_window, by), extents(points, resolution, by), resolution, by)
    return on.withColumn("hag", clamp(F.col("z") - F.col("ground"), low, high).cast("float")).drop("ground")


def height_summary(points: DataFrame, by: str = "plot") -> DataFrame:
    """Extremes of the height, percent of valid points above ground, mean height of tree points."""
    ok = F.col("label") != -1
    return points.groupBy(by).agg(
        F.min("hag").alias("hag_min"), F.max("hag").alias("hag_max"),
        (100 * F.try_divide(F.count_if(ok & (F.col("hag") > 0)), F.count_if(ok))).alias("above_pct"), F.avg(F.when(F.col("label") == 1, F.col("hag"))).alias("tree_hag"),
    )
