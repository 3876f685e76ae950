"""Neighbourhoods: kernels on tiles, range joins on bins, and the kernels that need order.

``radius_count`` and ``knn`` run on ``tiles``: each task gets one square tile with a halo as wide
as the search radius, so no neighbourhood is cut, no plot meets one task whole, and a dense place
makes no rows of pairs.  ``radius_join`` returns pairs and is relational: bins of the radius, an equi-join
on the bin and a residual distance; ``nearest_of`` has no bound and doubles the radius for points that need it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.draws import draw_of
from stemline.operators.selection import percentiles
from stemline.sources.shared import keep


def radius_join(a: DataFrame, b: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id") -> DataFrame:
    """(by, key, other, d2) of the pairs within the radius, both ends included.

    ``b`` has one row per bin; ``a`` probes the 3 ** axes bins around its own."""
    bins = [f"_b{i}" for i in range(len(axes))]
    own = lambda x: F.floor(F.col(x) / radius).cast("long")
    probe = a.select(by, key, *[F.col(x).cast("double").alias(f"_a{i}") for i, x in enumerate(axes)], *[own(x).alias(c) for x, c in zip(axes, bins, strict=True)])
    for c in bins:
        probe = probe.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    store = b.select(by, F.col(key).alias("other"), *[F.col(x).cast("double").alias(f"_o{i}") for i, x in enumerate(axes)], *[own(x).alias(c) for x, c in zip(axes, bins, strict=True)])
    d2 = reduce(lambda p, q: p + q, [(F.col(f"_a{i}") - F.col(f"_o{i}")) * (F.col(f"_a{i}") - F.col(f"_o{i}")) for i in range(len(axes))])
    return probe.join(store, [by, *bins]).select(by, key, "other", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def _placed(points: DataFrame, axes: tuple[str, ...], by: str, key: str) -> DataFrame:
    """(by, key, x, y, z) of points in two or three axes."""
    names = [F.col(a).cast("double").alias(n) for a, n in zip(axes, "xyz", strict=False)]
    return points.select(by, key, *names, *([F.lit(0.0).alias("z")] if len(axes) == 2 else []))


def radius_count(points: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id", tile: float = 4.0) -> DataFrame:
    """(by, key, density float): how many points lie within the radius, itself included; tiles are ``tile`` radii wide."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.flatnonzero(pdf["own"].to_numpy())
        _, _, within = grid_neighbours(pdf[["x", "y", "z"]].to_numpy(float), own, radius, 0)
        return pdf.loc[pdf["own"], [by, key]].assign(density=within.astype(np.float32))

    placed = _placed(points, axes, by, key)
    kinds = [placed.schema[c].dataType.simpleString() for c in (by, key)]
    return tiles(placed, tile * radius, radius, one, f"{by} {kinds[0]}, {key} {kinds[1]}, density float", by)


def nearest(pairs: DataFrame, k: int, keys: list[str], drop_self: tuple[str, str] | None = None) -> DataFrame:
    """The k pairs of least distance per key, ranked; ties go to the lower id."""
    p = pairs.where(F.col(drop_self[0]) != F.col(drop_self[1])) if drop_self else pairs
    order = W.partitionBy(*keys).orderBy("d2", "other")
    return p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(points: DataFrame, k: int, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id", tile: float = 4.0) -> DataFrame:
    """(by, key, other, d2, rank): up to k neighbours within the radius, the point itself excluded by its id; ties go to the lower id."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        x, names = pdf[["x", "y", "z"]].to_numpy(float), pdf[key].to_numpy()
        own = np.flatnonzero(pdf["own"].to_numpy())
        ids, _, _ = grid_neighbours(x, own, radius, k + 1)
        row, col = np.nonzero((ids >= 0) & (ids != own[:, None]))
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        keep = rank <= k
        row, a, b = row[keep], own[row[keep]], ids[row[keep], col[keep]]
        d = x[a] - x[b]
        squared = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        return pd.DataFrame({by: pdf[by].to_numpy()[a], key: names[a], "other": names[b], "d2": squared, "rank": rank[keep].astype(np.int32)})

    placed = _placed(points, axes, by, key)
    kinds = [placed.schema[c].dataType.simpleString() for c in (by, key)]
    return tiles(placed, tile * radius, radius, one, f"{by} {kinds[0]}, {key} {kinds[1]}, other {kinds[1]}, d2 double, rank int", by)


def finite(points: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """The points that have a place: no coordinate null, NaN or infinite."""
    return points.where(reduce(lambda p, q: p & q, [F.abs(F.col(a).cast("double")) < float("inf") for a in axes]))


def nearest_of(a: DataFrame, b: DataFrame, k: int, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id") -> DataFrame:
    """(by, key, other, d2, rank): the k points of ``b`` nearest to each of ``a``, however far; all of a plot's where it has fewer.

    The first search is within ``radius``; points that find too few there search again within twice
    of it, and so on.  Points without a place, and plots without points of ``b``, have no rows."""
    b = finite(b, axes)
    wanted = keep(b.groupBy(by).agg(F.least(F.count("*"), F.lit(k)).alias("_k")))
    left = finite(a, axes).join(wanted, by, "left_semi").select(by, key, *axes)
    done = []
    while True:
        near = nearest(radius_join(left, b, radius, axes, by, key), k, [by, key]).join(wanted, by)
        full = near.withColumn("_n", F.max("rank").over(W.partitionBy(by, key))).where("_n = _k").drop("_n", "_k")
        done.append(keep(full))
        left = keep(left.join(done[-1].where("rank = 1").select(by, key), [by, key], "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        radius *= 2


def interpolate(uncovered: DataFrame, covered: DataFrame, radius: float, k: int = 3, values: tuple[str, ...] = ("p0", "p1"), axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id", squared: bool = False) -> DataFrame:
    """(by, key, values): weighted means over the k nearest covered points, searched from ``radius`` on: weight 1 at distance 0, else 1 / (d + 1e-8), or ``squared`` 1 / (d**2 + 1e-8) everywhere.

    The one partner of a plot with one covered point is copied, whatever its weight."""
    near = nearest_of(uncovered, covered, k, radius, axes, by, key)
    named = covered.select(by, F.col(key).alias("other"), *values)
    d = F.sqrt("d2")
    w = 1 / (F.col("d2") + 1e-8) if squared else F.when(d == 0, 1.0).otherwise(1 / (d + 1e-8))
    return near.join(named, [by, "other"]).groupBy(by, key).agg(*[(F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values])


def nearest_summary(pairs: DataFrame, by: str = "plot", key: str = "point_id") -> DataFrame:
    """Mean, greatest, 95th and 99th percentile of the distance to the nearest partner; percentiles are selected by counting, not in one buffer."""
    one = keep(pairs.groupBy(by, key).agg(F.sqrt(F.min("d2")).alias("d")))
    at = percentiles(one, (0.95, 0.99), "d", by)
    ranked = at.groupBy(by).agg(*[F.max(F.when(F.col("share") == p, F.col("d"))).alias(name) for name, p in (("p95", 0.95), ("p99", 0.99))])
    return one.groupBy(by).agg(F.avg("d").alias("mean"), F.max("d").alias("max")).join(ranked, by)


def ball_query(centres: DataFrame, points: DataFrame, radius: float, n: int, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id") -> DataFrame:
    """(by, key, members array): the first n ids in id order within the radius, padded with the first."""
    first = radius_join(centres, points, radius, axes, by, key).withColumn("_r", F.row_number().over(W.partitionBy(by, key).orderBy("other"))).where(F.col("_r") <= n)
    ids = F.array_sort(F.collect_list("other"))
    g = first.groupBy(by, key).agg(ids.alias("m"))
    return g.select(by, key, F.concat("m", F.array_repeat(F.get("m", F.lit(0)), F.lit(n) - F.size("m"))).alias("members"))


def farthest_points(points: DataFrame, n: int, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id", seed: int = 42) -> DataFrame:
    """(by, rank, key): n points per group, each the farthest from those before; the start is drawn by the seed.  Groups are sampled blocks."""
    kind = f"{by} string, rank int, {key} long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = pdf[list(axes)].to_numpy(float)
        least = np.full(len(x), np.inf)
        at = int(draw_of(seed, pdf[by].iloc[0]) * len(x))
        taken = []
        for _ in range(min(n, len(x))):
            taken.append(at)
            least = np.minimum(least, ((x - x[at]) ** 2).sum(1))
            at = int(least.argmax())
        return pd.DataFrame({by: pdf[by].iloc[0], "rank": range(len(taken)), key: pdf[key].to_numpy()[taken]})

    return points.select(by, key, *axes).groupBy(by).applyInPandas(one, kind)


def sample_and_group(points: DataFrame, n_centres: int, radius: float, n: int, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id", seed: int = 42) -> DataFrame:
    """(by, key, members): farthest points as centres, each with its first n points within the radius."""
    centres = points.join(farthest_points(points, n_centres, axes, by, key, seed).select(by, key), [by, key])
    return ball_query(centres, points, radius, n, axes, by, key)


def group_all(points: DataFrame, by: str = "plot", key: str = "point_id") -> DataFrame:
    """(by, members): one group of all points of a sampled block, in id order."""
    return points.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("members"))


def tiles(points: DataFrame, size: float, halo: float, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: str = "plot") -> DataFrame:
    """Run ``kernel`` on square tiles; its input has ``own``, False for the halo's points, whose rows it must not return."""
    reach = lambda a: F.sequence(F.floor((F.col(a) - halo) / size), F.floor((F.col(a) + halo) / size))
    spread = points.withColumn("_tx", F.explode(reach("x"))).withColumn("_ty", F.explode(reach("y")))
    own = (F.floor(F.col("x") / size) == F.col("_tx")) & (F.floor(F.col("y") / size) == F.col("_ty"))
    return spread.withColumn("own", own).groupBy(by, "_tx", "_ty").applyInPandas(kernel, schema)


#: pairs that a kernel holds at a time
PAIRS = 1 << 21


def grid_neighbours(x: np.ndarray, queries: np.ndarray, radius: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids (q, k), distances (q, k), how many lie within radius) by a hash grid; -1 and inf where there are fewer; self included; ties go to the earlier row."""
    cell = np.floor(x / radius).astype(np.int64)
    cell -= cell.min(0) - 1
    span = cell.max(0) + 2
    code = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    ids, dist, within = np.full((len(queries), k), -1), np.full((len(queries), k), np.inf), np.zeros(len(queries), np.int64)
    # the three cells of a column along z are one range of the sorted codes, so a query has nine ranges
    column = code[queries][:, None] + np.array([(i * span[1] + j) * span[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    low, high = np.searchsorted(sorted_code, column - 1), np.searchsorted(sorted_code, column + 1, "right")
    total = np.cumsum((high - low).sum(1))
    for part in np.split(np.arange(len(queries)), np.unique(np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)))) if len(queries) else []:
        if not len(part):
            continue
        size = (high[part] - low[part]).ravel()
        start = np.repeat(low[part].ravel() - (np.cumsum(size) - size), size)
        q, other = np.repeat(part, size.reshape(len(part), -1).sum(1)), order[start + np.arange(size.sum())]
        d = x[queries[q]] - x[other]
        d = np.sqrt((d * d).sum(1))
        near = d <= radius
        q, other, d = q[near], other[near], d[near]
        within[part] = np.bincount(q - part[0], minlength=len(part))
        if not k:
            continue
        first = np.lexsort((other, d, q))
        q, other, d = q[first], other[first], d[first]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        few = rank < k
        ids[q[few], rank[few]], dist[q[few], rank[few]] = other[few], d[few]
    return ids, dist, within
