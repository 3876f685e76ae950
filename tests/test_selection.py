"""Order statistics by counting and farthest points by buckets, against the plain forms."""

import numpy as np
import pandas as pd
import pytest

from stemline.functions.draws import draw_of
from stemline.operators import farthest, neighbors, selection


def test_order_statistics_of_uneven_values(spark):
    rng = np.random.default_rng(4)
    groups = {"ties": np.repeat([2.0, 2.0, 7.0], 50), "wide": np.exp(rng.normal(0, 40, 400)), "one": np.array([3.0]), "signs": rng.normal(size=300)}
    rows = pd.DataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], columns=["plot", "v"])
    ranks = pd.DataFrame([(g, r) for g, vs in groups.items() for r in {0, len(vs) // 3, len(vs) - 1, len(vs)}] + [("none", 0)], columns=["plot", "rank"])
    got = {(r.plot, r["rank"]): r.v for r in selection.order_statistics(spark.createDataFrame(rows), spark.createDataFrame(ranks), "v").collect()}
    assert got == {(g, r): sorted(vs)[r] for g, vs in groups.items() for r in {0, len(vs) // 3, len(vs) - 1}}
    shares = (0.0, 0.37, 0.95, 1.0)
    for r in selection.percentiles(spark.createDataFrame(rows), shares, "v").collect():
        assert np.isclose(r.v, np.percentile(groups[r.plot], 100 * r.share), rtol=1e-12)
    assert selection.percentiles(spark.createDataFrame(rows).limit(0), shares, "v").count() == 0


def plain(name, x, n):
    least, at, out = np.full(len(x), np.inf), int(draw_of(42, name) * len(x)), []
    for _ in range(min(n, len(x))):
        out.append(at)
        least = np.minimum(least, ((x - x[at]) ** 2).sum(1))
        at = int(least.argmax())
    return out


@pytest.mark.parametrize("buckets", [8, 512])
def test_farthest_points_equal_the_plain_loop(spark, buckets):
    rng = np.random.default_rng(9)
    plots = {
        "lattice": np.stack(np.meshgrid(range(12), range(9), [0.0], indexing="ij"), -1).reshape(-1, 3).astype(float),  # ties everywhere
        "cloud": rng.normal(size=(500, 3)),
        "outlier": np.concatenate([rng.normal(size=(200, 3)), [[1e6, 0, 0]]]),
        "copies": np.repeat([[1.0, 1, 1], [2, 2, 2]], 10, 0),
        "single": np.array([[4.0, 4, 4]]),
    }
    rows = pd.DataFrame([(name, i, *map(float, p)) for name, x in plots.items() for i, p in enumerate(x)] + [("cloud", 10_000, float("nan"), 0.0, 0.0)], columns=["plot", "point_id", "x", "y", "z"])
    got = farthest.farthest_points(spark.createDataFrame(rows).repartition(3), 24, buckets=buckets).toPandas().sort_values(["plot", "rank"])
    for name, x in plots.items():
        assert got[got["plot"] == name]["point_id"].tolist() == plain(name, x, 24)
    empty = spark.createDataFrame(rows).limit(0)
    assert farthest.farthest_points(empty, 5).count() == 0
    assert neighbors.nearest_summary(spark.createDataFrame([], "plot string, point_id long, d2 double")).count() == 0
