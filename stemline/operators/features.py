"""The 27 geometric features of a point at two neighbourhood sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemline.config import Features
from stemline.operators.neighbors import grid_neighbours, tiles

#: The order of the features at one scale.
SCALE_NAMES = (
    "linearity", "planarity", "sphericity", "omnivariance", "anisotropy", "eigenentropy", "sum_eigenvalues", "change_curvature",
    "HAG", "verticality", "roughness", "height_range", "intensity",
)
NAMES = tuple(f"{n}_{s}" for s in ("k20", "k50") for n in SCALE_NAMES) + ("density",)
EPS = 1e-10


def shape_features(values: np.ndarray) -> np.ndarray:
    """(n, 8) from eigenvalues (n, 3) in falling order."""
    v = np.maximum(values, EPS)
    total = v.sum(1)
    share = v / total[:, None]
    return np.stack(
        [(v[:, 0] - v[:, 1]) / v[:, 0], (v[:, 1] - v[:, 2]) / v[:, 0], v[:, 2] / v[:, 0], np.cbrt(share.prod(1)), (v[:, 0] - v[:, 2]) / v[:, 0], -(share * np.log(share + EPS)).sum(1), total, v[:, 2] / total], 1
    )


def scale(x: np.ndarray, hag: np.ndarray, intensity: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(len(at), 13) features over neighbour lists with -1 for none; zeros below four neighbours."""
    out = np.zeros((len(at), 13))
    there = ids >= 0
    n = there.sum(1)
    ok = np.flatnonzero(n >= 4)
    if not len(ok):
        return out
    w = there[ok][:, :, None].astype(float)
    p = x[np.maximum(ids[ok], 0)]
    k = n[ok][:, None].astype(float)
    mean = (p * w).sum(1) / k
    away = (p - mean[:, None, :]) * w
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", away, away) / k[:, :, None])
    z = p[:, :, 2]
    inside = there[ok]
    out[ok, :8] = shape_features(values[:, ::-1])
    out[ok, 8] = hag[at[ok]]
    out[ok, 9] = 1 - np.abs(vectors[:, 2, 0])
    out[ok, 10] = np.sqrt(np.einsum("nk,nk->n", away[:, :, 2], away[:, :, 2]) / k[:, 0])
    out[ok, 11] = np.where(inside, z, -np.inf).max(1) - np.where(inside, z, np.inf).min(1)
    out[ok, 12] = intensity[at[ok]]
    return out


def extract(points: DataFrame, cfg: Features = Features(), tile: float = 5.0, by: str = "plot") -> DataFrame:  # noqa: B008
    """(by, point_id, the 27 features): tiles with a halo as wide as the greatest neighbour distance.

    The point itself is left out of its neighbours by its id, not by its place in the list."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy(float)
        own = np.flatnonzero(pdf["own"].to_numpy())
        if not len(own):
            return pd.DataFrame({by: [], "point_id": [], **dict.fromkeys(NAMES, [])}).astype({by: str, "point_id": "int64", **dict.fromkeys(NAMES, "float32")})
        ids, _, _ = grid_neighbours(x, own, cfg.max_neighbor_distance, cfg.k_large + 1)
        itself = ids == own[:, None]
        last = ~itself.any(1)
        itself[last, -1] = True
        others = ids[~itself].reshape(len(own), -1)
        _, _, dense = grid_neighbours(x, own, cfg.density_radius, 0)
        hag, light = pdf["hag"].to_numpy(float), pdf["intensity"].to_numpy(float)
        f = np.concatenate([scale(x, hag, light, own, others[:, : cfg.k_small]), scale(x, hag, light, own, others), dense[:, None]], 1)
        out = pd.DataFrame(f.astype(np.float32), columns=list(NAMES))
        out.insert(0, "point_id", pdf["point_id"].to_numpy()[own])
        out.insert(0, by, pdf[by].to_numpy()[own])
        return out

    schema = f"{by} string, point_id long, " + ", ".join(f"`{n}` float" for n in NAMES)
    return tiles(points.select(by, "point_id", "x", "y", "z", "hag", "intensity"), tile, cfg.max_neighbor_distance, one, schema, by)


def covariance(pairs: DataFrame, points: DataFrame, by: str = "plot", key: str = "point_id") -> DataFrame:
    """The six covariances of each point's neighbours (divisor: their number), and their count, in built-in aggregates."""
    p = points.select(by, F.col(key).alias("other"), "x", "y", "z")
    axes = ("x", "y", "z")
    terms = [F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(axes) for b in axes[i:]]
    return pairs.join(p, [by, "other"]).groupBy(by, key).agg(F.count("*").alias("k"), *terms)


def eigenvalues(cov: DataFrame) -> DataFrame:
    """``cov`` with l1 >= l2 >= l3 of the symmetric 3 x 3 matrix, by the trigonometric form, in built-in expressions."""
    xx, xy, xz, yy, yz, zz = (F.col(f"c{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz"))
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    with_ = cov.withColumn("_q", q).withColumn("_p", p)
    b: Column = F.col("_p")
    n = lambda v: F.try_divide(v, b)
    a11, a22, a33, a12, a13, a23 = n(xx - F.col("_q")), n(yy - F.col("_q")), n(zz - F.col("_q")), n(xy), n(xz), n(yz)
    det = a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det / 2, F.lit(1.0))))
    angle = F.acos(r) / 3
    l1 = F.col("_q") + 2 * F.col("_p") * F.cos(angle)
    l3 = F.col("_q") + 2 * F.col("_p") * F.cos(angle + 2 * np.pi / 3)
    return with_.withColumn("l1", l1).withColumn("l3", l3).withColumn("l2", 3 * F.col("_q") - l1 - l3).drop("_q", "_p")


def verticality(eigen: DataFrame) -> DataFrame:
    """``eigen`` with ``verticality``: 1 less the height of the unit vector of the least eigenvalue, in built-in expressions.

    That vector's squared parts are the diagonal of the adjugate of the matrix less the eigenvalue, over its trace.  Where the two least
    eigenvalues differ by less than a millionth of the greatest, no vector is the normal, and the verticality is 0."""
    xx, xy, xz, yy, yz, zz = (F.col(f"c{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz"))
    a, b, c = xx - F.col("l3"), yy - F.col("l3"), zz - F.col("l3")
    up, trace = a * b - xy * xy, (a * b - xy * xy) + (b * c - yz * yz) + (a * c - xz * xz)
    alone = F.col("l2") - F.col("l3") > 1e-6 * F.col("l1")
    return eigen.withColumn("verticality", F.when(alone, 1 - F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(up, trace))))).otherwise(0.0))
