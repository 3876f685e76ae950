"""Queries over all of their rows against brute force that shares no code with them."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from stemline import config
from stemline.operators import ml, neighbors, stats
from stemline.plans import queries as core
from stemline.plans.projections import METRICS_SQL, POINTS_SQL

TABLES = ("region", "nation", "customer", "orders", "events")


def sql(data, text):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con.execute(text).df()


def all_sums(signs):
    """Sums of one choice of each pair, in whole numbers: 2**n of them."""
    total = np.zeros(1, np.int64)
    for a, b in signs:
        total = np.concatenate([total + a, total + b])
    return total


def differences(data, a="1-URGENT", b="2-HIGH", value="f1"):
    """One difference per plot, rounded to 9 digits, in units of the last."""
    d = sql(data, f'WITH {METRICS_SQL} SELECT a.plot, b."{value}" - a."{value}" AS d FROM m a JOIN m b ON a.plot = b.plot WHERE a.method = \'{a}\' AND b.method = \'{b}\' ORDER BY 1')["d"]
    return np.rint(d.to_numpy() * 1e9).astype(np.int64)


def flip_p(d):
    return (np.abs(all_sums([(x, -x) for x in d])) >= abs(d.sum())).mean()


def wilcoxon_p(d):
    d = d[d != 0]
    r = (2 * pd.Series(np.abs(d)).rank()).astype(int).to_numpy()
    w = min(r[d > 0].sum(), r[d < 0].sum())
    return w / 2, min(1, 2 * (all_sums([(0, x) for x in r]) <= w).mean())


def test_paired_tests_see_all_plots(spark, data):
    d = differences(data)
    flips, ranks = core.sign_flip_test(spark, data).first(), core.signed_rank_test(spark, data).first()
    assert (flips.n, flips.n_permutations) == (25, 2**25)
    assert flips.observed == pytest.approx(d.mean() / 1e9, abs=1e-6) and flips.p_value == pytest.approx(flip_p(d), abs=1e-6)
    w, p = wilcoxon_p(d)
    assert (ranks.n_plots, ranks.n_nonzero_pairs, ranks.W) == (25, (d != 0).sum(), w) and ranks.p_wilcoxon == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 7, 12])
def test_counts_equal_enumeration(n):
    d = np.random.default_rng(n).integers(-4, 5, n)
    sums = all_sums([(x, -x) for x in d])
    for name, extreme in (("two-sided", np.abs(sums) >= abs(d.sum())), ("greater", sums >= d.sum()), ("less", sums <= d.sum())):
        assert stats.count_flips([x / 10 for x in d.tolist()], name) == (pytest.approx(d.mean() / 10), extreme.sum())
    if (d != 0).sum() >= 2:
        w, p = wilcoxon_p(d)
        assert stats.count_ranks((2 * pd.Series(np.abs(d[d != 0])).rank()).astype(int).tolist(), int(2 * w)) == p


def test_nearest_partners_have_no_bound(spark, data):
    p = sql(data, f"WITH {POINTS_SQL} SELECT * FROM p")
    means, far = {}, {}
    for plot, g in p.groupby("plot"):
        c, u = (g[(g["point_id"] % 3 == 0) == covered].sort_values("point_id") for covered in (True, False))
        d2 = ((u[["x", "y"]].to_numpy()[:, None] - c[["x", "y"]].to_numpy()[None]) ** 2).sum(2)
        at = np.argsort(d2, axis=1, kind="stable")[:, :3]
        d = np.sqrt(np.take_along_axis(d2, at, 1))
        w = np.where(d == 0, 1, 1 / (d + 1e-8))
        means |= dict(zip(u["point_id"], (w * c["gt_id"].to_numpy()[at] / 12).sum(1) / w.sum(1), strict=True))
        far[plot] = (d[:, 0].mean(), d[:, 0].max(), *np.percentile(d[:, 0], [95, 99]))
    got = {r.point_id: r.v for r in core.inverse_distance(spark, data).collect()}
    assert got == pytest.approx(means, abs=2e-6)
    summary = {r.plot: (r["mean"], r["max"], r.p95, r.p99) for r in core.coverage_distances(spark, data).collect()}
    assert summary.keys() == far.keys() and all(summary[x] == pytest.approx(far[x], abs=2e-6) for x in far)


def test_nearest_of_odd_points(spark):
    kind = "plot string, point_id long, x double, y double"
    nan = float("nan")
    a = spark.createDataFrame([("A", 1, 0.0, 0.0), ("A", 2, 900.0, 0.0), ("A", 3, nan, 0.0), ("A", 4, None, 0.0), ("A", 5, float("inf"), 0.0), ("B", 6, 0.0, 0.0)], kind)
    b = spark.createDataFrame([("A", 11, 0.0, 5.0), ("A", 12, 3.0, 0.0), ("A", 13, nan, nan)], kind)
    got = sorted((r.point_id, r.other, r["rank"]) for r in neighbors.nearest_of(a, b, 3, 5.0, ("x", "y")).collect())
    assert got == [(1, 11, 2), (1, 12, 1), (2, 11, 2), (2, 12, 1)]
    assert neighbors.nearest_of(a.limit(0), b, 3, 5.0, ("x", "y")).count() == 0


def test_far_points_are_interpolated(spark):
    n = 40
    x = np.where(np.arange(n) < n - 1, np.arange(n) / 10, 500.0)
    cloud = spark.createDataFrame(pd.DataFrame({"plot": "A", "point_id": np.arange(n), "x": x, "y": 0.0, "z": 0.0, "hag": 0.0, "intensity": 0.5, "label": 1}))
    tree = lambda blocks: np.tile([0.1, 0.9], (*blocks.shape[:2], 1))
    whole, _ = ml.block_inference(cloud, tree, 1, 5.0, config.Blocks(points=8))
    assert {(r.semantic_pred, round(r.p0, 6)) for r in whole.collect()} == {(1, 0.1)}


def test_upserted_means_are_of_all_plots(spark, data):
    want = sql(data, f"WITH {METRICS_SQL} SELECT method, AVG(CASE WHEN method = '2-HIGH' THEN recall ELSE f1 END) AS v FROM m GROUP BY method")
    got = {r.method: r.mean_f1 for r in core.best_params_upsert(spark, data).collect()}
    assert got == pytest.approx(dict(zip(want["method"], want["v"], strict=True)), abs=2e-6)


def test_paired_table_has_both_tests_of_everything(spark, data):
    rows = core.paired_table(spark, data).collect()
    assert len({(r.comparison, r.metric) for r in rows}) == len(rows) == 15
    for r in rows:
        d = differences(data, r.method_a, r.method_b, r.metric)
        assert (r.n_plots, r.n_permutations) == (len(d), 2 ** len(d))
        assert r.mean_diff == pytest.approx(d.mean() / 1e9, abs=2e-6) and r.std_diff == pytest.approx(d.std(ddof=1) / 1e9, abs=2e-6)
    r = min(rows, key=lambda r: (r.comparison, r.metric))
    assert r.perm_p_value == pytest.approx(flip_p(differences(data, r.method_a, r.method_b, r.metric)), abs=2e-6)
    for r in rows:
        if r.metric == "f1":
            w, p = wilcoxon_p(differences(data, r.method_a, r.method_b, r.metric))
            assert (r.W, r.p_wilcoxon) == pytest.approx((w, p), abs=2e-6), r.comparison
