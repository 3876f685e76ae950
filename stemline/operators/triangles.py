"""Linear interpolation of empty grid cells over the Delaunay triangulation of the filled ones, without a plot in one task.

Nobody needs the whole triangulation: an empty cell needs the one triangle that holds it, and that is
the triangle of filled cells round it with no filled cell inside its circle.  Three facts keep the work local:

* A filled cell whose four neighbours are filled is no corner of a triangle that holds an empty cell (its
  Voronoi cell lies in the unit square round it), so only the fringes of gaps are looked at.
* The convex hull of a plot comes from the ends of its rows.  With its corners every tile has a triangle round each
  cell to begin with, and knows which cells lie outside.
* A triangle found in a tile and its halo is right if its circle, cut to the hull's box, lies inside
  them.  Cells for which it does not search again in tiles four times as wide, until it does.

Corners are compared in whole numbers, so nothing depends on the tile.  Filled cells on one circle with an empty inside are cut as a
fan from the first of them in (iy, ix) order.  Cells outside the hull, and all of a plot whose
filled cells lie on one line, take the nearest filled cell, the first in (iy, ix) order of equals.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.operators.neighbors import nearest_of
from stemline.sources.shared import keep, release

OPEN, SETTLED, OUTSIDE = 0, 1, 2
#: rows of a plot whose ends meet in one hull before hulls are merged
ROWS = 4096


def convex(p: np.ndarray) -> np.ndarray:
    """Positions in ``p`` of the corners of its convex hull, counterclockwise; none if it has no area."""
    order = np.lexsort((p[:, 1], p[:, 0]))

    def half(ids: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = p[out[-2]].tolist(), p[out[-1]].tolist(), p[i].tolist()
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out[:-1]

    ring = half(order) + half(order[::-1])
    return np.array(ring if len(ring) > 2 else [], int)


def hulls(known: DataFrame, by: str = "plot") -> DataFrame:
    """(by, at, ix, iy, z): the corners of each plot's convex hull, counterclockwise; no rows for a plot without area."""
    rows = known.groupBy(by, "iy").agg(F.min(F.struct("ix", "z")).alias("a"), F.max(F.struct("ix", "z")).alias("b"))
    ends = rows.select(by, "iy", F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select(by, "e.ix", "iy", "e.z")
    kind = f"{by} {known.schema[by].dataType.simpleString()}"

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        # a part without area keeps its ends, for others may give it some
        ring = convex(pdf[["ix", "iy"]].to_numpy(np.int64))
        return pdf.iloc[ring] if len(ring) else pdf.sort_values(["iy", "ix"]).iloc[[0, -1]].drop_duplicates()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = pdf.iloc[convex(pdf[["ix", "iy"]].to_numpy(np.int64))]
        return ring.assign(at=np.arange(len(ring)))[[by, "at", "ix", "iy", "z"]]

    few = ends.groupBy(by, F.floor(F.col("iy") / ROWS)).applyInPandas(part, f"{kind}, ix long, iy long, z double")
    return few.groupBy(by).applyInPandas(whole, f"{kind}, at long, ix long, iy long, z double")


def fringe(empty: DataFrame, known: DataFrame, by: str = "plot") -> DataFrame:
    """The filled cells beside an empty one."""
    steps = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    beside = empty.select(by, F.explode(steps).alias("c")).select(by, "c.ix", "c.iy").distinct()
    return known.join(beside, [by, "ix", "iy"], "left_semi")


def _cross(a: tuple, b: tuple) -> np.ndarray:
    return a[0] * b[1] - a[1] * b[0]


def _fan(ring: np.ndarray) -> int:
    """The place i of a ring round the origin, so that corners 0, i and i + 1 hold it."""
    first = ring[0]
    for i in range(2, len(ring)):
        if (ring[i, 0] - first[0]) * -first[1] - (ring[i, 1] - first[1]) * -first[0] <= 0:
            return i - 1
    return len(ring) - 2


def circles(q: np.ndarray, p: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places ``q`` within the hull ``p[:h]``: three corners in ``p`` (-1: outside the hull), the weights of the corners, (centre x, centre y, radius)."""
    far = int(max(np.abs(p.max(0) - q.min(0)).max(), np.abs(q.max(0) - p.min(0)).max()))
    # products of four distances must be exact: beyond 8,192 cells in Python's own whole numbers
    number = np.int64 if far <= 1 << 13 else object
    x, y = (p[None, :, a].astype(number) - q[:, None, a].astype(number) for a in (0, 1))
    lift = x * x + y * y
    m, every = len(q), np.arange(len(q))
    nxt = np.r_[1:h, 0]
    inside = (x[:, :h] * y[:, nxt] - y[:, :h] * x[:, nxt] >= 0).all(1)
    # orientation of (corner 0, corner i, place): the place is the origin
    side = (x[:, 2:h] - x[:, :1]) * -y[:, :1] - (y[:, 2:h] - y[:, :1]) * -x[:, :1]
    i = np.argmax(side <= 0, 1) + 1
    tri = np.stack([np.zeros(m, int), i, i + 1], 1)
    ball = np.zeros((m, 3))
    live = every[inside]
    while len(live):
        t = tri[live]
        (ax, bx, cx), (ay, by, cy), (al, bl, cl) = ([v[live, t[:, k]] for k in range(3)] for v in (x, y, lift))
        area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        alpha = al * (by - cy) + bl * (cy - ay) + cl * (ay - by)
        beta = al * (cx - bx) + bl * (ax - cx) + cl * (bx - ax)
        gamma = al * (bx * cy - cx * by) + bl * (cx * ay - ax * cy) + cl * (ax * by - bx * ay)
        # negative strictly inside the circle of the corners, zero on it
        gap = area[:, None] * lift[live] - alpha[:, None] * x[live] - beta[:, None] * y[live] - gamma[:, None]
        enter = gap.argmin(1)
        ready = gap[np.arange(len(live)), enter] >= 0
        for k in np.flatnonzero(ready):
            row, a, b = live[k], float(alpha[k]) / float(area[k]) / 2, float(beta[k]) / float(area[k]) / 2
            ball[row] = q[row, 0] + a, q[row, 1] + b, np.sqrt(max(float(gamma[k]) / float(area[k]) + a * a + b * b, 0.0))
            on = np.flatnonzero(gap[k] == 0)
            if len(on) > 3:
                ring = np.stack([x[row, on], y[row, on]], 1)
                turn = np.argsort(np.arctan2((ring[:, 1] - b).astype(float), (ring[:, 0] - a).astype(float)))
                least = min(range(len(turn)), key=lambda s: tuple(p[on[turn[s]]][::-1]))  # noqa: B023
                turn = np.roll(turn, -least)
                s = _fan(ring[turn])
                tri[row] = on[turn[[0, s, s + 1]]]
        live, t, enter = live[~ready], t[~ready], enter[~ready]
        # the new corner takes the place of one that leaves the place inside, where it gets weight if it can
        best, swap = np.full(len(live), -1, number), t.copy()
        for k in range(3):
            new = t.copy()
            new[:, k] = enter
            a, b, c = ((x[live, new[:, j]], y[live, new[:, j]]) for j in range(3))
            w = (_cross(b, c), _cross(c, a), _cross(a, b))
            better = (w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0) & (w[0] + w[1] + w[2] > 0) & (w[k] > best)
            best[better], swap[better] = w[k][better], new[better]
        tri[live] = swap
    a, b, c = ((x[every, tri[:, j]], y[every, tri[:, j]]) for j in range(3))
    weights = np.stack([_cross(b, c), _cross(c, a), _cross(a, b)], 1).astype(float)
    weights[~inside] = 1.0
    tri[~inside] = -1
    return tri, weights / weights.sum(1, keepdims=True), ball


def _search(left: DataFrame, rim: DataFrame, hull: DataFrame, halo: int, by: str) -> DataFrame:
    """(by, ix, iy, z, state) of the cells ``left``, from tiles twice as wide as their halo."""
    core = 2 * halo
    at = lambda c, o: F.floor((F.col(c) + o) / core)
    cells = left.select(by, at("ix", 0).alias("tx"), at("iy", 0).alias("ty"), "ix", "iy", F.lit(None).cast("double").alias("z"), F.lit(-1).cast("long").alias("at"))
    wanted = cells.select(by, "tx", "ty").distinct()
    reach = lambda c: F.explode(F.sequence(at(c, -halo), at(c, halo)))
    near = rim.withColumn("tx", reach("ix")).withColumn("ty", reach("iy")).join(wanted, [by, "tx", "ty"], "left_semi")
    near = near.select(by, "tx", "ty", "ix", "iy", "z", F.lit(1 << 40).cast("long").alias("at"))
    ring = wanted.join(hull, by).select(by, "tx", "ty", "ix", "iy", "z", "at")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = pdf[pdf["at"] >= 0].sort_values(["at", "iy", "ix"]).drop_duplicates(["ix", "iy"])
        h = int((corners["at"] < 1 << 40).sum())
        p, z = corners[["ix", "iy"]].to_numpy(np.int64), corners["z"].to_numpy(float)
        cells = pdf[pdf["at"] < 0]
        low, high = p[:h].min(0), p[:h].max(0)
        start = pdf[["tx", "ty"]].to_numpy(np.int64)[0] * core - halo
        parts = []
        for some in np.array_split(cells[["ix", "iy"]].to_numpy(np.int64), max(1, len(cells) * len(p) >> 20)):
            tri, w, ball = circles(some, p, h)
            margin = 1e-6 * (1 + ball[:, 2:])
            seen = (np.maximum(ball[:, :2] - ball[:, 2:] - margin, low) > start - 1) & (np.minimum(ball[:, :2] + ball[:, 2:] + margin, high) < start + core + 2 * halo)
            state = np.where(tri[:, 0] < 0, OUTSIDE, np.where(seen.all(1), SETTLED, OPEN))
            parts.append(pd.DataFrame({by: cells[by].iloc[0], "ix": some[:, 0], "iy": some[:, 1], "z": np.where(state == SETTLED, (z[tri] * w).sum(1), np.nan), "state": state}))
        return pd.concat(parts)

    rows = cells.unionByName(near).unionByName(ring)
    return rows.groupBy(by, "tx", "ty").applyInPandas(one, f"{by} {left.schema[by].dataType.simpleString()}, ix long, iy long, z double, state int")


def fill(cells: DataFrame, by: str = "plot", halo: int = 16) -> DataFrame:
    """(by, ix, iy, z) without nulls in z, of all cells (by, ix, iy, z) of grids that have a value.

    A plot without any value has no rows; repeated cells and null plots are not expected."""
    cells = keep(cells.select(by, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("z").cast("double").alias("z")))
    known, empty = cells.where("z is not null"), cells.where("z is null")
    if empty.isEmpty():
        return known
    rim, hull = keep(fringe(empty, known, by)), keep(hulls(known, by))
    left, done = empty.join(hull.select(by).distinct(), by, "left_semi").select(by, "ix", "iy"), []
    outside = [empty.join(hull, by, "left_anti").select(by, "ix", "iy")]
    rounds = []
    while True:
        rounds.append(keep(_search(left, rim, hull, halo, by)))
        done.append(rounds[-1].where(f"state = {SETTLED}").select(by, "ix", "iy", "z"))
        outside.append(rounds[-1].where(f"state = {OUTSIDE}").select(by, "ix", "iy"))
        left = rounds[-1].where(f"state = {OPEN}").select(by, "ix", "iy")
        if left.isEmpty():
            break
        halo *= 4
    placed = lambda df, *more: df.select(by, F.struct("iy", "ix").alias("id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), *more)
    bare, corners = placed(reduce(DataFrame.unionByName, outside)), placed(rim, "z")
    near = nearest_of(bare, corners, 1, 4.0, ("x", "y"), by, "id").select(by, "id", "other")
    last = near.join(corners.select(by, F.col("id").alias("other"), "z"), [by, "other"]).select(by, "id.ix", "id.iy", "z")
    out = keep(reduce(DataFrame.unionByName, [known, *done, last]))
    release(cells, rim, hull, *rounds)
    return out
