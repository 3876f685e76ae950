"""Spanning forests of voxels and peaks of surfaces, over many tiles, against one voxel or cell at a time."""

import heapq

import numpy as np
import pytest

from stemline.config import Watershed
from stemline.operators import forest, segment


def grown(d, markers):
    """{voxel: marker}: of all faces between labelled and unlabelled voxels the first is taken, again and again."""
    label, heap = dict(markers), []

    def push(at):
        for axis in range(3):
            for step in (-1, 1):
                to = tuple(c + step * (k == axis) for k, c in enumerate(at))
                if to in d and to not in label:
                    heapq.heappush(heap, (-min(d[at], d[to]), -max(d[at], d[to]), min(at, to), max(at, to), at, to))

    for at in markers:
        push(at)
    while heap:
        *_, at, to = heapq.heappop(heap)
        if to not in label:
            label[to] = label[at]
            push(to)
    return {at: label.get(at, 0) for at in d}


@pytest.mark.parametrize(("tile", "levels", "few"), [(64, 4, 0), (4, 4, 0), (2, 3, 100), (1, 1, 0), (1, 1, 1 << 16), (3, 1000, 1 << 16)])
def test_forest_equals_growth_voxel_by_voxel(spark, tile, levels, few):
    rng = np.random.default_rng(tile)
    rows, want = [], {}
    for plot in ("A", "B", "C"):
        cells = {tuple(map(int, c)) for c in rng.integers(0, (14, 11, 5), (420, 3))}
        d = {c: float(rng.integers(levels)) for c in cells}
        at = sorted(cells)
        markers = {at[i]: k for k, i in enumerate(rng.choice(len(at), 6, replace=False), 1)} if plot != "C" else {}
        want |= {(plot, *c): m for c, m in grown(d, markers).items()}
        rows += [(plot, *c, d[c], markers.get(c)) for c in cells]
    voxels = spark.createDataFrame(rows, "plot string, vi int, vj int, vk int, d double, marker int").repartition(5)
    found = forest.spanning_labels(voxels, tile=tile, few=few).collect()
    got = {(r.plot, r.vi, r.vj, r.vk): r.label for r in found}
    assert len(found) == len(want) and got == want and (set(got.values()) == set(range(7)) or levels > 4)


def test_forest_of_a_long_chain_and_far_voxels(spark):
    """A chain over many tiles, one voxel far away (no box is laid round them), and an empty table."""
    rows = [("A", i, 0, 0, float(-i), 1 if i == 0 else 2 if i == 199 else None) for i in range(200)] + [("A", 2_000_000, 2_000_000, 9, 5.0, None)]
    voxels = spark.createDataFrame(rows, "plot string, vi int, vj int, vk int, d double, marker int")
    got = {r.vi: r.label for r in forest.spanning_labels(voxels, tile=4, few=0).collect()}
    assert got == {i: 2 if i == 199 else 1 for i in range(200)} | {2_000_000: 0}
    assert forest.spanning_labels(voxels.limit(0)).count() == 0
    with pytest.raises(Exception, match="voxel index"):
        forest.spanning_labels(spark.createDataFrame([("A", 1 << 21, 0, 0, 1.0, 1)], voxels.schema)).count()


def suppressed(cells, d, threshold):
    top = [(s, i, j) for (i, j), s in cells.items() if s > threshold and all(s >= v for (a, b), v in cells.items() if abs(a - i) <= d and abs(b - j) <= d)]
    taken = []
    for s, i, j in sorted(top, key=lambda t: (-t[0], t[1], t[2])):
        if all(abs(i - a) > d or abs(j - b) > d for _, a, b in taken):
            taken.append((s, i, j))
    return sorted((i, j, s) for s, i, j in taken)


@pytest.mark.parametrize(("tile", "d", "levels"), [(128, 2, 3), (5, 2, 2), (1, 1, 1), (3, 4, 2), (7, 1, 50)])
def test_peaks_equal_one_at_a_time(spark, tile, d, levels):
    rng = np.random.default_rng(d)
    cells = {(int(i), int(j)): float(1 + rng.integers(levels)) for i, j in rng.integers(0, (25, 18), (330, 2))}
    surface = spark.createDataFrame([("A", i, j, s, d) for (i, j), s in cells.items()] + [("B", 5, 5, 9.0, d)], "plot string, vi int, vj int, s double, d int").repartition(3)
    got = segment.peaks(surface, 0.5, tile=tile).collect()
    assert sorted((r.vi, r.vj, r.s) for r in got if r.plot == "A") == suppressed(cells, d, 0.5)
    assert [(r.vi, r.vj) for r in got if r.plot == "B"] == [(5, 5)]


def test_segments_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(8)
    voxels = spark.createDataFrame([("A", int(i), int(j), int(k), int(n)) for i, j, k, n in {(int(a), int(b), int(c)): (a, b, c, rng.integers(1, 4)) for a, b, c in rng.integers(0, (24, 20, 9), (900, 3))}.values()], "plot string, vi int, vj int, vk int, n long")
    p = Watershed(voxel_size=0.5, min_crown_radius_m=1.0, gaussian_sigma=0.7, top_band_m=1.5)
    for seeding in segment.SEEDINGS:
        found = [sorted(segment.label_voxels(voxels, seeding, p, tile=t).collect()) for t in (64, 3)]
        assert found[0] == found[1] and len({r.label for r in found[0]}) > 3
