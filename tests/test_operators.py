"""Kernels and edge cases on small clouds with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemline import config
from stemline.config import Config, Features, Watershed
from stemline.functions import draws
from stemline.operators import features, gridsearch, labels, matching, ml, neighbors, raster, report, sampling, segment, semantic, stats, voxel


def points(spark, rows, names):
    return spark.createDataFrame(pd.DataFrame(rows, columns=names.split()))


def cones(seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for tree, (cx, cy) in enumerate([(0.0, 0.0), (8.0, 0.0)], 1):
        h = rng.uniform(1, 6, 900)
        a, r = rng.uniform(0, 2 * np.pi, 900), (6.5 - h) / 6 * rng.uniform(0, 1.2, 900)
        out += [("A", tree, float(cx + x), float(cy + y), float(z)) for x, y, z in zip(r * np.cos(a), r * np.sin(a), h)]
    return pd.DataFrame(out, columns=["plot", "gt_id", "x", "y", "hag"]).assign(point_id=range(1800))


@pytest.mark.parametrize("seeding", ["chm", "density"])
def test_two_cones_are_two_trees(spark, seeding):
    p = spark.createDataFrame(cones())
    got = segment.segment(p, seeding, Watershed(voxel_size=0.4, min_crown_radius_m=2.0, gaussian_sigma=0.5))
    score = matching.scores(got.withColumnRenamed("instance_id", "pred_id")).first()
    assert (score.TP, score.FP, score.FN, score.f1) == (2, 0, 0, 1.0)


def test_flat_canopy_needs_density_seeds(spark):
    cells = [(x, y, 10, 1 + 9 * (abs(x - 6) < 2 and abs(y - 6) < 2) + 9 * (abs(x - 23) < 2 and abs(y - 6) < 2)) for x in range(30) for y in range(12)]
    p = Watershed(voxel_size=0.3, min_crown_radius_m=2.4, gaussian_sigma=1.0)
    found = segment.seeds(spark.createDataFrame([("A", *c) for c in cells], "plot string, vi int, vj int, vk int, n long"), "density", p).collect()
    assert {(6, 6), (23, 6)} <= {(r.vi, r.vj) for r in found}


def test_no_seeds_and_empty_input(spark):
    p = spark.createDataFrame(cones())
    none = segment.segment(p, "chm", Watershed(voxel_size=0.5, min_tree_height=100.0))
    assert none.where("instance_id <> 0").count() == 0
    assert segment.segment(p.limit(0), "chm").count() == 0


def test_small_segments(spark):
    p = points(spark, [("A", i, 1 if i < 49 else 2) for i in range(99)], "plot point_id instance_id")
    assert {r.instance_id for r in voxel.drop_small(p, 50).collect()} == {0, 2}


def test_constant_and_tilted_terrain(spark):
    rows = [("A", i, float(x), float(y), 0.1 * x, 2) for i, (x, y) in enumerate((x, y) for x in np.arange(0, 20, 0.25) for y in np.arange(0, 20, 0.5))]
    rows += [("A", 10_000 + i, float(x), 10.0, 0.1 * x + 5.0, 5) for i, x in enumerate(range(4, 17))]
    got = raster.heights(points(spark, rows, "plot point_id x y z classification"), smooth_window=2).where("classification = 5 AND x BETWEEN 7 AND 13").toPandas()
    assert np.allclose(got["hag"], 5.0, atol=0.08)


def test_terrain_without_ground_raises(spark):
    p = points(spark, [("A", 0, 0.0, 0.0, 0.0, 5)], "plot point_id x y z classification")
    with pytest.raises(Exception, match="no ground"):
        raster.heights(p).collect()


def filled(spark, grid):
    """raster.fill of a dense grid [iy, ix] with NaN for empty cells."""
    rows = [("A", int(i), int(j), None if np.isnan(v) else float(v)) for (j, i), v in np.ndenumerate(grid)]
    out = np.full(grid.shape, np.nan)
    for r in raster.fill(spark.createDataFrame(rows, "plot string, ix long, iy long, z double")).collect():
        assert np.isnan(out[r.iy, r.ix])
        out[r.iy, r.ix] = r.z
    return out


def brute_fill(grid):
    known = [(j, i) for (j, i), v in np.ndenumerate(grid) if not np.isnan(v)]
    out = grid.copy()
    for (j, i), v in np.ndenumerate(grid):
        if not np.isnan(v):
            continue
        total = weight = 0.0
        for line, at in ((grid[j], i), (grid[:, i], j)):
            there = np.flatnonzero(~np.isnan(line))
            if len(there):
                w = 1 / max(0.5, np.abs(there - at).min())
                total, weight = total + w * np.interp(at, there, line[there]), weight + w
        out[j, i] = total / weight if weight else grid[min(known, key=lambda k: ((k[0] - j) ** 2 + (k[1] - i) ** 2, k))]
    return out


def test_fill_keeps_planes_and_smooth_keeps_mass(spark):
    g = np.add.outer(np.arange(6.0), 2 * np.arange(7.0))
    holed = g.copy()
    holed[2, 3] = holed[4, 1] = np.nan
    assert np.allclose(filled(spark, holed), g)
    x = np.random.default_rng(0).random((9, 4))
    assert np.isclose(raster.smooth(x, 1.0).sum(), x.sum())


@pytest.mark.parametrize("share", [0.5, 0.1, 0.02])
def test_fill_equals_brute_force(spark, share):
    rng = np.random.default_rng(int(100 * share))
    g = np.where(rng.random((13, 17)) < share, rng.random((13, 17)), np.nan)
    g[3, 4] = 1.0
    assert np.allclose(filled(spark, g), brute_fill(g))


def test_sparse_smoothing_equals_dense(spark):
    rng = np.random.default_rng(2)
    dense = (rng.random((5, 4, 6)) > 0.5) * rng.integers(1, 9, (5, 4, 6))
    dense[4, 3, 5] = 1
    at = np.argwhere(dense)
    v = points(spark, [("A", *map(int, a), int(dense[tuple(a)])) for a in at], "plot vi vj vk n")
    got = voxel.smooth(v, 0.5).toPandas()
    want = raster.smooth(dense.astype(float), 0.5)
    assert np.allclose([want[r.vi, r.vj, r.vk] for r in got.itertuples()], got["density"])


def test_matching_ties_take_the_lower_prediction(spark):
    p = points(spark, [("A", 1, 1)] * 5 + [("A", 2, 1)] * 5, "plot pred_id gt_id")
    pairs = matching.overlaps(p)
    assert [(r.pred_id, r.iou) for r in matching.matches(pairs).collect()] == [(1, 0.5)]
    assert matching.matches(pairs, 0.3).count() == 1
    with pytest.raises(ValueError):
        matching.matches(pairs, 0.0)


def test_scores_of_empty_sides(spark):
    no_gt = matching.scores(points(spark, [("A", 1, 0)], "plot pred_id gt_id")).first()
    assert (no_gt.TP, no_gt.FP, no_gt.FN, no_gt.f1, no_gt.over_seg) == (0, 1, 0, 0.0, 0.0)
    no_pred = matching.scores(points(spark, [("A", 0, 3)], "plot pred_id gt_id")).first()
    assert (no_pred.TP, no_pred.FP, no_pred.FN, no_pred.recall) == (0, 0, 1, 0.0)
    assert matching.set_iou([], []) == 0.0 and matching.set_iou([1, 2], [2, 3]) == 1 / 3


def greedy(rows, threshold):
    """(plot, pred, gt) by falling overlap, one pair after the other."""
    taken = []
    for plot, p, g, iou in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if iou >= threshold and not any(t[0] == plot and (t[1] == p or t[2] == g) for t in taken):
            taken.append((plot, p, g))
    return sorted(taken)


def test_relational_matching_equals_greedy(spark):
    rng = np.random.default_rng(3)
    p = points(spark, [(str(rng.integers(3)), int(g) if rng.random() < 0.8 else int(rng.integers(5)), int(g)) for g in rng.integers(0, 5, 600)], "plot pred_id gt_id")
    pairs = matching.overlaps(p)
    key = lambda df: sorted((r.plot, r.pred_id, r.gt_id) for r in df.collect())
    rows = [(r.plot, r.pred_id, r.gt_id, r.iou) for r in pairs.collect()]
    for threshold in (0.5, 0.3, 0.02):
        assert key(matching.matches(pairs, threshold)) == greedy(rows, threshold)
    ties = points(spark, [("A", p, g, 0.25) for p in range(1, 7) for g in range(1, 7) if (p + g) % 3] + [("B", 1, 1, 0.4)], "plot pred_id gt_id iou")
    assert key(matching.matches(ties, 0.2)) == greedy([tuple(r) for r in ties.collect()], 0.2)
    assert matching.matches(ties, 0.45).count() == 0


def test_shapes_of_line_plane_ball():
    rng = np.random.default_rng(4)
    t = rng.random((1, 4000, 3))
    shapes = {0: t * [1, 0, 0], 1: t * [1, 1, 0], 2: rng.normal(size=(1, 4000, 3))}
    for k, x in shapes.items():
        v = np.linalg.eigvalsh(np.cov(x[0].T, bias=True))[::-1]
        assert features.shape_features(v[None])[0, k] > 0.85
    assert np.allclose(features.shape_features(np.zeros((1, 3)))[0, 2], 1)


def test_features_are_tile_independent(spark):
    rng = np.random.default_rng(5)
    p = spark.createDataFrame(pd.DataFrame(rng.random((400, 3)) * [12, 12, 3], columns=["x", "y", "z"]).assign(plot="A", point_id=range(400), hag=1.0, intensity=0.5))
    cfg = Features(k_small=8, k_large=15, max_neighbor_distance=2.0)
    a, b = (features.extract(p, cfg, tile).toPandas().sort_values("point_id")[list(features.NAMES)].to_numpy() for tile in (3.0, 100.0))
    assert a.shape == (400, 27) and np.allclose(a, b, atol=1e-5)


def test_features_without_neighbours_are_zero_but_for_density(spark):
    p = spark.createDataFrame(pd.DataFrame({"plot": "A", "point_id": [0, 1], "x": [0.0, 50.0], "y": 0.0, "z": 0.0, "hag": 1.0, "intensity": 0.5}))
    f = features.extract(p).toPandas()[list(features.NAMES)].to_numpy()
    assert (f[:, :-1] == 0).all() and (f[:, -1] == 1).all()


def test_closed_form_eigenvalues(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame(pd.DataFrame(rng.random((60, 3)), columns=["x", "y", "z"]).assign(plot="A", point_id=range(60)))
    got = features.eigenvalues(features.covariance(neighbors.knn(p, 10, 2.0), p)).toPandas()
    for r in got.head(10).itertuples():
        m = np.array([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]])
        assert np.allclose(np.linalg.eigvalsh(m)[::-1], [r.l1, r.l2, r.l3], atol=1e-9)


def test_farthest_points_and_normalisation(spark):
    p = spark.createDataFrame(pd.DataFrame({"plot": "A", "point_id": range(5), "x": [0.0, 1, 2, 3, 10], "y": 0.0, "z": 0.0}))
    taken = {r.point_id for r in neighbors.farthest_points(p, 2).collect()}
    assert 4 in taken or 0 in taken
    assert sampling.block_normalised(p).agg(F.max(F.abs("x"))).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_samples(spark):
    p = spark.range(100).select(F.lit("A").alias("plot"), F.col("id").alias("point_id"), (F.col("id") % 3 - 1).cast("int").alias("label"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert sampling.cap_per_class(p, 5).count() == 15
    assert sorted(r.position for r in sampling.block(p.limit(7), 20).collect()) == list(range(20))
    assert sampling.block(p, 20).select("point_id").distinct().count() == 20
    assert sampling.pass_blocks(p, 3, 10).groupBy("pass").count().select("count").distinct().collect()[0][0] == 10
    assert sampling.split_plots(p.select(F.col("point_id").cast("string").alias("plot"))).where("split = 'val'").count() == 20
    assert p.select(sampling.passes(F.lit(100_000)).alias("n")).first().n == 50
    assert sampling.augment(p).count() == 100
    import zlib

    assert p.select(sampling.plot_seed(F.col("plot")).alias("s")).first().s == (42 + zlib.crc32(b"A")) & 0x7FFFFFFF


def test_draws_are_the_same_everywhere(spark):
    rows = spark.range(2000).select("id", draws.draw(42, F.lit("a"), "id").alias("u"), draws.normal(7, "id").alias("n"), draws.whole(F.lit(42), F.col("id"), F.lit(3)).alias("w")).toPandas()
    assert rows["u"].tolist() == [draws.draw_of(42, "a", i) for i in rows["id"]]
    assert abs(rows["u"].mean() - 0.5) < 0.03 and abs(rows["n"].mean()) < 0.1 and abs(rows["n"].std() - 1) < 0.06
    x = (42 * 1_000_003 + 5 * 65_539 + 3 * 257 + 1) % draws.PRIME
    for k in draws.ROUNDS:
        x = (x * x + k) % draws.PRIME
    assert rows["w"][5] == x and abs(rows["w"].mean() / draws.PRIME - 0.5) < 0.03


def test_pass_blocks_take_the_least_draws(spark):
    p = spark.range(3000).select(F.when(F.col("id") < 40, "small").otherwise("large").alias("plot"), F.col("id").alias("point_id"))
    got = sampling.pass_blocks(p, 4, 50).groupBy("plot", "pass").agg(F.sort_array(F.collect_list("point_id")).alias("ids")).collect()
    for r in got:
        all_ids = range(40) if r.plot == "small" else range(40, 3000)
        assert r.ids == sorted(sorted(all_ids, key=lambda i: (draws.draw_of(42, r["pass"], r.plot, i), i))[:50])


def test_forest_and_block_inference(spark):
    rng = np.random.default_rng(7)
    n = 400
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({c: rng.random(n) + y for c in features.NAMES}).assign(plot=np.where(np.arange(n) % 2, "A", "B"), point_id=np.arange(n), label=y)
    model = ml.train_forest(spark.createDataFrame(pdf), config.Forest(trees=5, max_depth=4))
    out = ml.predict_forest(model, spark.createDataFrame(pdf.head(300)), spark.createDataFrame(pdf[["plot", "point_id"]])).toPandas()
    assert (out["semantic_pred"] == -1).sum() == 100
    right = out[out["semantic_pred"] >= 0].merge(pdf[["point_id", "label"]])
    assert (right["semantic_pred"] == right["label"]).mean() > 0.9

    cloud = spark.createDataFrame(pd.DataFrame({"plot": "A", "point_id": np.arange(n), "x": rng.random(n), "y": rng.random(n), "z": 3.0 * y, "hag": 3.0 * y, "intensity": 0.5, "label": y}))
    x5 = np.stack([rng.normal(size=n), rng.normal(size=n), 2.0 * y - 1, y * 0.06, np.full(n, 0.5)], 1)
    whole, cover = ml.block_inference(cloud, ml.perceptron_scorer(x5, y), 2, 5.0, config.Blocks(points=64))
    got = whole.toPandas().merge(pd.DataFrame({"point_id": np.arange(n), "label": y}))
    assert len(got) == n and (got["semantic_pred"] == got["label"]).mean() > 0.9
    assert 64 <= cover.first().covered <= 128


def test_grid_search_finds_the_best(spark):
    p = spark.createDataFrame(cones())
    grid = {"voxel_size": (0.4,), "gaussian_sigma": (0.5,), "min_crown_radius_m": (0.4, 2.0)}
    got = gridsearch.summarise(gridsearch.score_plots(p, "chm", grid), grid).toPandas()
    assert got.iloc[0]["mean_f1"] == 1.0 and len(got) == 2
    assert len(gridsearch.combinations(gridsearch.GRID)) == 36 and len(gridsearch.combinations(gridsearch.GRID_DENSITY)) == 108
    best = gridsearch.best(gridsearch.summarise(gridsearch.score_plots(p, "chm", grid), grid), "rf").first()
    assert best.method == "rf" and best.top_band_m is None


def test_statistics(spark):
    d = points(spark, [("c", f"p{i}", v) for i, v in enumerate([0.1, 0.2, 0.3, -0.05, 0.0])], "comparison plot d")
    t = stats.sign_flip_test(d, ["comparison"]).first()
    assert t.n_permutations == 32 and t.p_value == 8 / 32
    w = stats.wilcoxon(d, ["comparison"]).first()
    assert (w.n_nonzero_pairs, w.W, w.p_wilcoxon) == (4, 1.0, 0.25)
    few = stats.wilcoxon(points(spark, [("c", "p", 0.0), ("c", "q", 1.0)], "comparison plot d"), ["comparison"]).first()
    assert few.p_wilcoxon is None and few.note
    sets = spark.createDataFrame([("a", [float(x) for x in range(11)], 1), ("b", [2.0], 2), ("c", [], 3), ("d", [4.0, 4.0], 4)], "name string, values array<double>, seed int")
    got = {r.name: r for r in stats.bca(sets, ["name", "seed"], 4000).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"].ci_lower < got["a"].observed == 5 < got["a"].ci_upper and got["a"].n == 11
    assert got["b"][2:5] == (2.0, 2.0, 2.0) and got["d"][2:5] == (4.0, 4.0, 4.0)
    x, rng = np.arange(11.0), np.random.default_rng(1)
    wide = x[rng.integers(0, 11, (4000, 11))].mean(1)
    assert [got["a"].ci_lower, got["a"].ci_upper] == pytest.approx(np.percentile(wide, [2.5, 97.5]), abs=0.25)


def test_semantic_edge_cases(spark):
    m = semantic.metrics(points(spark, [("A", 1, 1), ("A", 0, -1), ("A", -1, 1)], "plot label semantic_pred"), ["plot"]).first()
    assert (m.sem_accuracy, m.sem_iou_tree, m.sem_iou_notree, m.sem_n_points_evaluated) == (0.5, 1.0, 0.0, 2)
    one = semantic.batch_miou(points(spark, [("A", 1, 1)], "plot label semantic_pred"), ["plot"]).first()
    assert one.miou == 1.0


def test_labels(spark):
    p = points(spark, [("A", i, c) for i, c in enumerate([0, 1, 2, 3, 4, 5, 6, 9])], "plot point_id classification")
    assert [r[0] for r in p.orderBy("point_id").select(labels.binary_label()).collect()] == [-1, 0, 0, -1, 1, 1, 1, -1]
    assert p.select(labels.institution(F.lit("A/b")).alias("x"), labels.institution(F.lit("A__b")).alias("y")).first()[:] == ("A", "unknown")


def test_report_edges(spark):
    m = points(spark, [("m1", "A", "p1", 0.5), ("m1", "B", "p2", 0.7), ("m2", "A", "p1", 0.6)], "method institution plot f1")
    loo = {(r.excluded_site, r.method): r for r in report.leave_one_out(m).collect()}
    assert loo["none", "m1"].mean_f1 == pytest.approx(0.6) and loo["A", "m1"].std_f1 is None and ("A", "m2") not in loo
    s = {r.excluded_site: r for r in report.rank_stability(report.leave_one_out(m)).collect()}
    assert s["A"].rank_2 == "—"
    assert "0.600" in report.latex(m.withColumn("method", F.lit("rf")), ["f1"])


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("watershed:\n  voxel_size: 0.2  # metres\nforest:\n  trees: 10\n")
    c = config.load(str(f))
    assert c.watershed.voxel_size == 0.2 and c.forest.trees == 10 and c.data == Config().data
    with pytest.raises(ValueError):
        config.from_mapping({"nope": {}})
