"""Gaps filled over a triangulation: against all triangles of a small grid, planes, tiles of any width, and odd grids."""

import itertools

import numpy as np
import pytest

from stemline.operators import triangles


def filled(spark, grid, halo=16):
    """The fill of a dense grid [iy, ix] with NaN for empty cells."""
    rows = [("A", int(i), int(j), None if np.isnan(v) else float(v)) for (j, i), v in np.ndenumerate(grid)]
    out = np.full(grid.shape, np.nan)
    for r in triangles.fill(spark.createDataFrame(rows, "plot string, ix long, iy long, z double"), halo=halo).collect():
        assert np.isnan(out[r.iy, r.ix])
        out[r.iy, r.ix] = r.z
    return out


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def in_circle(a, b, c, d):
    """Positive inside the circle of a counterclockwise triangle, zero on it."""
    rows = [(p[0] - d[0], p[1] - d[1], (p[0] - d[0]) ** 2 + (p[1] - d[1]) ** 2) for p in (a, b, c)]
    (ax, ay, al), (bx, by, bl), (cx, cy, cl) = rows
    return ax * (by * cl - bl * cy) - ay * (bx * cl - bl * cx) + al * (bx * cy - by * cx)


def brute(grid):
    """Every triple of filled cells with an empty circle; of those that share a circle, the ones with its first cell."""
    known = [(i, j) for (j, i), v in np.ndenumerate(grid) if not np.isnan(v)]
    out, found = grid.copy(), []
    for a, b, c in itertools.combinations(known, 3):
        if turn(a, b, c) < 0:
            b, c = c, b
        if turn(a, b, c) == 0:
            continue
        side = [in_circle(a, b, c, d) for d in known]
        if max(side) > 0:
            continue
        ring = [d for d, s in zip(known, side, strict=True) if s == 0]
        first = min(ring, key=lambda p: p[::-1])
        # a triangle of the fan has the first cell and an edge of the ring
        if first in (a, b, c):
            u, v = [p for p in (a, b, c) if p != first]
            if len({turn(u, v, d) > 0 for d in ring if d not in (u, v)}) == 1:
                found.append((a, b, c))
    for (j, i), v in np.ndenumerate(grid):
        if not np.isnan(v):
            continue
        q = (i, j)
        for a, b, c in found:
            w = [turn(q, b, c), turn(a, q, c), turn(a, b, q)]
            if min(w) >= 0:
                out[j, i] = sum(x * grid[p[1], p[0]] for x, p in zip(w, (a, b, c), strict=True)) / sum(w)
                break
        else:
            out[j, i] = grid[min(known, key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p[::-1]))[::-1]]
    return out


@pytest.mark.parametrize(("share", "halo"), [(0.8, 1), (0.5, 2), (0.25, 1), (0.1, 16)])
def test_fill_equals_all_triangles(spark, share, halo):
    rng = np.random.default_rng(int(100 * share))
    g = np.where(rng.random((8, 11)) < share, rng.random((8, 11)), np.nan)
    g[1, 2] = g[6, 9] = g[5, 1] = 1.0
    assert np.allclose(filled(spark, g, halo), brute(g))


def test_kernel_equals_all_triangles():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        g = np.where(rng.random((7, 7)) < rng.choice([0.2, 0.4, 0.6]), rng.random((7, 7)), np.nan)
        known = np.array([(i, j) for (j, i), v in np.ndenumerate(g) if not np.isnan(v)])
        ring = triangles.convex(known)
        if not len(ring):
            continue
        p = np.concatenate([known[ring], np.delete(known, ring, 0)])
        q = np.array([(i, j) for (j, i), v in np.ndenumerate(g) if np.isnan(v)])
        want = brute(g)
        for shift in (0, 1 << 20):  # far places are compared in Python's own numbers
            far = np.concatenate([p, [[shift, shift]]]) if shift else p
            tri, w, _ = triangles.circles(q, far[:, :], len(ring))
            for (i, j), t, weight in zip(q, tri, w, strict=True):
                if t[0] >= 0:
                    assert np.isclose(sum(x * g[p[k][1], p[k][0]] for x, k in zip(weight, t, strict=True)), want[j, i])


def test_planes_are_kept_in_wide_gaps(spark):
    plane = np.add.outer(3.0 * np.arange(70), -2.0 * np.arange(90))
    g = plane.copy()
    g[5:60, 4:80] = np.nan
    assert np.allclose(filled(spark, g), plane)


def test_odd_grids(spark):
    nan = np.nan
    assert filled(spark, np.array([[1.0, 2.0]])).tolist() == [[1.0, 2.0]]
    assert filled(spark, np.array([[nan, 5.0], [nan, nan]])).tolist() == [[5.0, 5.0], [5.0, 5.0]]
    # filled cells on one line have no triangles
    assert filled(spark, np.array([[1.0, nan, nan, nan, 2.0]])).tolist() == [[1.0, 1.0, 1.0, 2.0, 2.0]]
    assert np.isnan(filled(spark, np.array([[nan, nan]]))).all()
