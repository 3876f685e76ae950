"""Registered queries of the relational operators, each with an independent SQL form for DuckDB where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.config import COMPARISONS, METHODS, Watershed
from stemline.functions.vectors import argmax, squared_distance
from stemline.operators import features, gridsearch, labels, matching, neighbors, raster, report, sampling, search, segment, semantic, spatial, stats, voxel
from stemline.plans.projections import metrics, points, table
from stemline.plans.registry import LABEL, ORACLE_SQL, PRIORITIES, QUERIES, RM, M, P, draw_sql, query, r6, rounded
from stemline.sources import tables

PAIRS = f"""{P},
cells AS (SELECT plot, pred_id, gt_id, COUNT(*) AS inter FROM p GROUP BY ALL),
np AS (SELECT plot, pred_id, SUM(inter) AS n_pred FROM cells WHERE pred_id > 0 GROUP BY ALL),
ng AS (SELECT plot, gt_id, SUM(inter) AS n_gt FROM cells WHERE gt_id > 0 GROUP BY ALL),
pairs AS (SELECT c.plot, c.pred_id, c.gt_id, c.inter, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_gt AS BIGINT) AS n_gt, c.inter / (n_pred + n_gt - c.inter) AS iou
  FROM cells c JOIN np ON c.plot = np.plot AND c.pred_id = np.pred_id JOIN ng ON c.plot = ng.plot AND c.gt_id = ng.gt_id),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY plot, gt_id ORDER BY iou DESC, pred_id) AS rg, ROW_NUMBER() OVER (PARTITION BY plot, pred_id ORDER BY iou DESC, gt_id) AS rp FROM pairs WHERE iou >= 0.5),
hit AS MATERIALIZED (SELECT * FROM ranked WHERE rg = 1 AND rp = 1)"""


# --- filters and projections -------------------------------------------------------------------


@query(f"{P} SELECT plot, classification, CAST({LABEL} AS INT) AS label, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY plot), 6) AS pct FROM p GROUP BY plot, classification")
def label_profile(spark: SparkSession, d: str) -> DataFrame:
    n = semantic.class_share(points(spark, d), ["plot"], "classification")
    return n.select("plot", "classification", labels.binary_label().alias("label"), "n", r6("pct"))


@query(f"{P} SELECT plot, point_id, ROUND(z, 6) AS z FROM p WHERE {LABEL} = 1 AND z >= 50")
def tree_filter(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("label", labels.binary_label())
    return labels.tree_points(p.withColumn("semantic_pred", F.col("label")), hag="z", min_hag=50.0).select("plot", "point_id", r6("z"))


@query(f"{P}, t AS (SELECT plot, MAX(z) AS top FROM p GROUP BY plot) SELECT p.plot, point_id, ROUND(CAST(CASE WHEN top > 0 THEN z / top ELSE z END AS FLOAT), 4) AS intensity FROM p JOIN t ON p.plot = t.plot")
def intensity_scaling(spark: SparkSession, d: str) -> DataFrame:
    return labels.scale_intensity(points(spark, d).withColumn("intensity", F.col("z"))).select("plot", "point_id", F.round("intensity", 4).alias("intensity"))


@query(f"{P} SELECT plot, point_id, CAST(CASE WHEN {LABEL} = 1 THEN gt_id ELSE 0 END AS BIGINT) AS instance_id FROM p")
def masked_scatter(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    part = p.where(labels.binary_label() == 1).select("plot", "point_id", F.col("gt_id").alias("instance_id"))
    return labels.scatter(p.select("plot", "point_id"), part, {"instance_id": 0})


@query(
    f"""{P}, k AS (SELECT plot, CASE WHEN {LABEL} = -1 THEN 'Excl' WHEN {LABEL} = 1 AND pred_id % 2 = 1 THEN 'TP' WHEN {LABEL} = 0 AND pred_id % 2 = 0 THEN 'TN' WHEN {LABEL} = 0 THEN 'FP' ELSE 'FN' END AS kind FROM p)
SELECT plot, kind, CAST(CASE kind WHEN 'TP' THEN 1 WHEN 'TN' THEN 0 WHEN 'FP' THEN 2 WHEN 'FN' THEN -2 END AS INT) AS overlay, COUNT(*) AS n FROM k GROUP BY ALL"""
)
def confusion_classes(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("plot", labels.binary_label().alias("g"), (F.col("pred_id") % 2).cast("int").alias("s"))
    return p.groupBy("plot", labels.confusion_class("g", "s").alias("kind"), labels.overlay_code("g", "s").cast("int").alias("overlay")).agg(F.count("*").alias("n"))


@query(f"{P}, b AS (SELECT plot, (MIN(y) + MAX(y)) / 2 AS mid FROM p GROUP BY plot) SELECT p.plot, COUNT(*) AS n, ROUND(AVG(z), 6) AS mean_z FROM p JOIN b ON p.plot = b.plot WHERE ABS(y - mid) <= 5 GROUP BY p.plot")
def slab_filter(spark: SparkSession, d: str) -> DataFrame:
    return labels.slab(points(spark, d), 5.0).groupBy("plot").agg(F.count("*").alias("n"), r6(F.avg("z"), "mean_z"))


@query(
    f"""{P}, b AS (SELECT plot, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM p GROUP BY plot)
SELECT p.plot, (x < x0 + (x1 - x0) * 10 / 100 OR x > x1 - (x1 - x0) * 10 / 100 OR y < y0 + (y1 - y0) * 10 / 100 OR y > y1 - (y1 - y0) * 10 / 100) AS border, COUNT(*) AS n FROM p JOIN b ON p.plot = b.plot GROUP BY ALL"""
)
def border_points(spark: SparkSession, d: str) -> DataFrame:
    return labels.border(points(spark, d), 10.0).groupBy("plot", "border").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type || '__' || CAST(event_id AS VARCHAR) AS plot, event_type AS institution FROM events")
def plot_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("path", F.concat(F.lit("/data/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".las")))
    key, parent = labels.plot_key("path")
    return e.select("event_id", key.alias("plot"), parent.alias("institution"))


# --- voxels, rasters, squares --------------------------------------------------------------------

VOX = f"""{P}, o AS (SELECT plot, MIN(x) AS x0, MIN(y) AS y0, MIN(z) AS z0 FROM p GROUP BY plot),
pv AS (SELECT p.*, CAST(FLOOR((x - x0) / 10.0) AS INT) AS vi, CAST(FLOOR((y - y0) / 10.0) AS INT) AS vj, CAST(FLOOR((z - z0) / 10.0) AS INT) AS vk FROM p JOIN o ON p.plot = o.plot),
v AS (SELECT plot, vi, vj, vk, COUNT(*) AS n FROM pv GROUP BY ALL)"""


def voxels(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelise(points(spark, d), 10.0, axes=("x", "y", "z"))


@query(f"{VOX} SELECT * FROM v")
def voxel_counts(spark: SparkSession, d: str) -> DataFrame:
    return voxel.counts(voxels(spark, d))


@query(f"{VOX} SELECT plot, vi, vj, MAX(vk) AS top_k, CAST(MAX(vk) * 10.0 AS FLOAT) AS chm_m FROM v GROUP BY ALL")
def canopy_heights(spark: SparkSession, d: str) -> DataFrame:
    return voxel.canopy(voxel.counts(voxels(spark, d)), 10.0)


@query(f"{VOX}, t AS (SELECT plot, vi, vj, MAX(vk) AS top_k FROM v GROUP BY ALL) SELECT v.plot, v.vi, v.vj, top_k, CAST(SUM(n) AS BIGINT) AS surface FROM v JOIN t ON v.plot = t.plot AND v.vi = t.vi AND v.vj = t.vj WHERE vk >= GREATEST(top_k - 3, 0) GROUP BY ALL")
def top_band_density(spark: SparkSession, d: str) -> DataFrame:
    return voxel.top_band(voxel.counts(voxels(spark, d)), 3)


@query(f"{VOX} SELECT plot, vi, vj, vk, n, CAST(SUM(n) OVER (PARTITION BY plot, vi, vj ORDER BY vk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM v")
def column_running_sum(spark: SparkSession, d: str) -> DataFrame:
    return voxel.running_density(voxel.counts(voxels(spark, d)))


@query(f"{P}, s AS (SELECT plot, pred_id, COUNT(*) AS c FROM p WHERE pred_id > 0 GROUP BY ALL) SELECT p.plot, p.point_id, CAST(CASE WHEN c < 60 THEN 0 ELSE p.pred_id END AS BIGINT) AS pred_id FROM p LEFT JOIN s ON p.plot = s.plot AND p.pred_id = s.pred_id")
def small_segments(spark: SparkSession, d: str) -> DataFrame:
    return voxel.drop_small(points(spark, d).select("plot", "point_id", "pred_id"), 60, instance="pred_id")


@query(f"{VOX} SELECT pv.plot, point_id, CAST(CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS BIGINT) AS instance_id FROM pv JOIN v ON pv.plot = v.plot AND pv.vi = v.vi AND pv.vj = v.vj AND pv.vk = v.vk")
def voxel_labels_to_points(spark: SparkSession, d: str) -> DataFrame:
    v = voxels(spark, d)
    even = voxel.counts(v).where("n % 2 = 0").withColumn("label", F.col("n"))
    return voxel.label_points(v, even).select("plot", "point_id", F.col("instance_id").cast("long").alias("instance_id"))


GRID = f"""{P}, e AS (SELECT plot, MIN(x) AS x0, MIN(y) AS y0, CAST(GREATEST(CEIL((MAX(x) + 20.0 - MIN(x)) / 20.0) - 1, 1) AS BIGINT) AS nx, CAST(GREATEST(CEIL((MAX(y) + 20.0 - MIN(y)) / 20.0) - 1, 1) AS BIGINT) AS ny FROM p GROUP BY plot),
g AS (SELECT p.plot, CAST(LEAST(GREATEST(FLOOR((x - x0) / 20.0), 0), nx - 1) AS BIGINT) AS ix, CAST(LEAST(GREATEST(FLOOR((y - y0) / 20.0), 0), ny - 1) AS BIGINT) AS iy, MEDIAN(z) AS z FROM p JOIN e ON p.plot = e.plot WHERE classification = 2 GROUP BY ALL)"""


@query(f"{GRID} SELECT plot, ix, iy, ROUND(z, 6) AS z FROM g")
def terrain_medians(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.ground_cells(points(spark, d), 20.0), "z")


@query(
    f"""{P}, b AS (SELECT plot, MIN(x) AS x0, MIN(y) AS y0, GREATEST(1, CEIL((MAX(x) - MIN(x)) / 25.0)) - 1 AS lx, GREATEST(1, CEIL((MAX(y) - MIN(y)) / 25.0)) - 1 AS ly FROM p GROUP BY plot),
n AS (SELECT p.plot, CAST(LEAST(FLOOR((x - x0) / 25.0), lx) AS BIGINT) AS px, CAST(LEAST(FLOOR((y - y0) / 25.0), ly) AS BIGINT) AS py, pred_id, COUNT(*) AS n FROM p JOIN b ON p.plot = b.plot WHERE pred_id > 0 GROUP BY ALL),
s AS (SELECT plot, pred_id, COUNT(*) AS size FROM p WHERE pred_id > 0 GROUP BY ALL)
SELECT n.plot, px, py, n.pred_id, n FROM n JOIN s ON n.plot = s.plot AND n.pred_id = s.pred_id QUALIFY ROW_NUMBER() OVER (PARTITION BY n.plot, px, py ORDER BY n DESC, size DESC, n.pred_id) = 1"""
)
def majority_raster(spark: SparkSession, d: str) -> DataFrame:
    return spatial.majority_raster(points(spark, d), 25.0, "pred_id")


@query(
    f"""{P}, b AS (SELECT plot, MIN(x) AS x0, MIN(y) AS y0, MAX(y) AS y1, GREATEST(25.0, GREATEST(MAX(x) - MIN(x), MAX(y) - MIN(y)) / 4000.0) AS s FROM p GROUP BY plot)
SELECT p.plot, CAST(FLOOR((x - x0) / s) AS BIGINT) AS px, CAST(FLOOR((y1 - y0) / s) - FLOOR((y - y0) / s) AS BIGINT) AS py, ARG_MAX(classification, point_id) AS classification FROM p JOIN b ON p.plot = b.plot GROUP BY ALL"""
)
def last_point_raster(spark: SparkSession, d: str) -> DataFrame:
    return spatial.last_point_raster(points(spark, d), 25.0, "classification")


@query(
    f"""{P}, c AS (SELECT plot, (MIN(x) + MAX(x)) / 2 AS mx, (MIN(y) + MAX(y)) / 2 AS my FROM p GROUP BY plot),
w AS (SELECT plot, mx + i * 10 AS cx, my + j * 10 AS cy, i, j FROM c, (SELECT UNNEST(RANGE(-5, 6)) AS i), (SELECT UNNEST(RANGE(-5, 6)) AS j)),
n AS (SELECT w.plot, cx, cy, i, j, COUNT(DISTINCT gt_id) AS n_trees FROM w JOIN p ON w.plot = p.plot AND ABS(x - cx) < 10 AND ABS(y - cy) < 10 WHERE gt_id > 0 GROUP BY ALL)
SELECT plot, cx, cy, n_trees FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY plot ORDER BY n_trees DESC, i, j) = 1"""
)
def densest_zone(spark: SparkSession, d: str) -> DataFrame:
    return spatial.densest_zone(points(spark, d))


@query(f"{P} SELECT plot, pred_id, COUNT(DISTINCT gt_id) AS n_gt, ROUND(AVG(x), 6) AS cx, ROUND(AVG(y), 6) AS cy FROM p WHERE pred_id > 0 GROUP BY plot, pred_id HAVING COUNT(DISTINCT gt_id) >= 2")
def merged_trees(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.merged_trees(points(spark, d), 2), "cx", "cy")


# --- neighbourhoods ------------------------------------------------------------------------------

FLAT = ("x", "y")


@query(f"{P} SELECT a.plot, a.point_id, CAST(COUNT(*) AS FLOAT) AS density FROM p a JOIN p b ON a.plot = b.plot AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 GROUP BY ALL")
def radius_density(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.radius_count(points(spark, d), 2.0, FLAT, tile=50.0)


KNN = f"""{P}, q AS (SELECT a.plot, a.point_id, b.point_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.plot = b.plot AND a.point_id <> b.point_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16),
k AS MATERIALIZED (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY plot, point_id ORDER BY d2, other) AS INT) AS "rank" FROM q QUALIFY "rank" <= 5)"""


@query(f'{KNN} SELECT plot, point_id, other, d2, "rank" FROM k')
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.knn(points(spark, d), 5, 4.0, FLAT, tile=25.0)


@query(f"""{KNN} SELECT k.plot, k.point_id, COUNT(*) AS k, ROUND(COVAR_POP(o.x, o.x), 6) + 0.0 AS cxx, ROUND(COVAR_POP(o.x, o.y), 6) + 0.0 AS cxy, ROUND(COVAR_POP(o.x, o.z), 6) + 0.0 AS cxz, ROUND(COVAR_POP(o.y, o.y), 6) + 0.0 AS cyy, ROUND(COVAR_POP(o.y, o.z), 6) + 0.0 AS cyz, ROUND(COVAR_POP(o.z, o.z), 6) + 0.0 AS czz FROM k JOIN p o ON k.plot = o.plot AND k.other = o.point_id GROUP BY k.plot, k.point_id""")
def neighbour_covariance(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    names = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    # no negative zeros
    return rounded(features.covariance(neighbors.knn(p, 5, 4.0, FLAT, tile=25.0), p), *names).withColumns({n: F.col(n) + 0.0 for n in names})


EIGEN_SQL = f"""{KNN}, c AS (SELECT k.plot, k.point_id, COUNT(*) AS k, COVAR_POP(o.x, o.x) AS xx, COVAR_POP(o.x, o.y) AS xy, COVAR_POP(o.x, o.z) AS xz, COVAR_POP(o.y, o.y) AS yy, COVAR_POP(o.y, o.z) AS yz, COVAR_POP(o.z, o.z) AS zz FROM k JOIN p o ON k.plot = o.plot AND k.other = o.point_id GROUP BY k.plot, k.point_id HAVING COUNT(*) >= 4),
q2 AS (SELECT *, (xx + yy + zz) / 3 AS m FROM c), q3 AS (SELECT *, SQRT(((xx - m) ** 2 + (yy - m) ** 2 + (zz - m) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM q2),
q4 AS (SELECT *, ACOS(GREATEST(-1, LEAST(1, COALESCE(((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / NULLIF(2 * s * s * s, 0), 1)))) / 3 AS phi FROM q3),
q5 AS (SELECT *, m + 2 * s * COS(phi) AS l1, m + 2 * s * COS(phi + 2 * PI() / 3) AS l3 FROM q4), q6 AS (SELECT *, 3 * m - l1 - l3 AS l2, (xx - l3) * (yy - l3) - xy * xy AS up, (xx - l3) * (yy - l3) - xy * xy + (yy - l3) * (zz - l3) - yz * yz + (xx - l3) * (zz - l3) - xz * xz AS trace FROM q5)
SELECT plot, point_id, ROUND(l1, 4) + 0.0 AS l1, ROUND(l2, 4) + 0.0 AS l2, ROUND(l3, 4) + 0.0 AS l3, ROUND(CASE WHEN l2 - l3 > 1e-6 * l1 THEN 1 - SQRT(LEAST(1, GREATEST(0, up / trace))) ELSE 0 END, 3) + 0.0 AS verticality FROM q6"""


@query(EIGEN_SQL)
def neighbour_eigen(spark: SparkSession, d: str) -> DataFrame:
    """Eigenvalues and verticality of every point's neighbourhood of four or five."""
    p = points(spark, d)
    found = features.verticality(features.eigenvalues(features.covariance(neighbors.knn(p, 5, 4.0, FLAT, tile=25.0), p).where("k >= 4")))
    return found.select("plot", "point_id", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("l1", 4), ("l2", 4), ("l3", 4), ("verticality", 3))])



@query(f"""{P}, c AS (SELECT * FROM p WHERE point_id % 3 = 0), u AS (SELECT * FROM p WHERE point_id % 3 <> 0),
q AS (SELECT u.plot, u.point_id, (u.x - c.x) * (u.x - c.x) + (u.y - c.y) * (u.y - c.y) AS d2, c.gt_id / 12.0 AS v FROM u JOIN c ON u.plot = c.plot QUALIFY ROW_NUMBER() OVER (PARTITION BY u.plot, u.point_id ORDER BY d2, c.point_id) <= 3),
w AS (SELECT *, CASE WHEN d2 = 0 THEN 1.0 ELSE 1 / (SQRT(d2) + 1e-8) END AS w FROM q) SELECT plot, point_id, ROUND(SUM(w * v) / SUM(w), 6) AS v FROM w GROUP BY ALL""")
def inverse_distance(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("v", F.col("gt_id") / 12.0)
    return rounded(neighbors.interpolate(p.where("point_id % 3 <> 0"), p.where("point_id % 3 = 0"), 5.0, 3, ("v",), FLAT), "v")


@query(f"""{P}, n AS (SELECT u.plot, u.point_id, SQRT(MIN((u.x - c.x) * (u.x - c.x) + (u.y - c.y) * (u.y - c.y))) AS d FROM p u JOIN p c ON u.plot = c.plot AND c.point_id % 3 = 0 WHERE u.point_id % 3 <> 0 GROUP BY ALL)
SELECT plot, ROUND(AVG(d), 6) AS mean, ROUND(MAX(d), 6) AS max, ROUND(QUANTILE_CONT(d, 0.95), 6) AS p95, ROUND(QUANTILE_CONT(d, 0.99), 6) AS p99 FROM n GROUP BY plot""")
def coverage_distances(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(neighbors.nearest_summary(neighbors.nearest_of(p.where("point_id % 3 <> 0"), p.where("point_id % 3 = 0"), 1, 5.0, FLAT)), "mean", "max", "p95", "p99")


@query(f"""{P}, q AS (SELECT c.plot, c.point_id, o.point_id AS other, ROW_NUMBER() OVER (PARTITION BY c.plot, c.point_id ORDER BY o.point_id) AS r FROM p c JOIN p o ON c.plot = o.plot AND (c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) <= 9 WHERE c.point_id % 10 = 0),
g AS (SELECT plot, point_id, LIST(other ORDER BY other) AS m FROM q WHERE r <= 4 GROUP BY ALL)
SELECT plot, point_id, ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(4), lambda i: COALESCE(m[i + 1], m[1])), ',') AS members FROM g""")
def ball_query(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    b = neighbors.ball_query(p.where("point_id % 10 = 0"), p, 3.0, 4, FLAT)
    return b.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


EMB_Q = "q AS (SELECT vec_id AS q, embedding AS e, label FROM embeddings WHERE vec_id % 20 = 0)"
D2 = "LIST_SUM(LIST_TRANSFORM(LIST_ZIP(q.e, b.embedding), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) * (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE))))"


@query(f'WITH {EMB_Q}, a AS (SELECT q, b.vec_id AS other, {D2} AS d2 FROM q JOIN embeddings b ON q.q <> b.vec_id) SELECT q, other, ROUND(d2, 6) AS d2, CAST(ROW_NUMBER() OVER (PARTITION BY q ORDER BY d2, other) AS INT) AS "rank" FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY q ORDER BY d2, other) <= 10')
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(search.vector_knn(e.where("vec_id % 20 = 0"), e, 10), "d2")


# --- instance and semantic scores ------------------------------------------------------------------


@query(f"{PAIRS} SELECT plot, pred_id, gt_id, CAST(inter AS BIGINT) AS inter, n_pred, n_gt, ROUND(iou, 6) AS iou FROM pairs")
def instance_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.overlaps(points(spark, d)), "iou")


@query(f"{PAIRS} SELECT plot, pred_id, gt_id, ROUND(iou, 6) AS iou FROM hit")
def instance_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.matches(matching.overlaps(points(spark, d))).select("plot", "pred_id", "gt_id", r6("iou"))


@query(
    f"""{PAIRS}, h AS (SELECT plot, COUNT(*) AS c, AVG(iou) AS miou FROM hit GROUP BY plot),
s AS (SELECT p.plot, COUNT(DISTINCT CASE WHEN gt_id > 0 THEN gt_id END) AS n_gt_trees, COUNT(DISTINCT CASE WHEN pred_id > 0 THEN pred_id END) AS n_pred_trees FROM p GROUP BY p.plot),
t AS (SELECT s.*, CAST(COALESCE(c, 0) AS BIGINT) AS "TP", COALESCE(miou, 0) AS miou FROM s LEFT JOIN h ON s.plot = h.plot)
SELECT plot, "TP", n_pred_trees - "TP" AS "FP", n_gt_trees - "TP" AS "FN", ROUND("TP" / n_pred_trees, 6) AS "precision", ROUND("TP" / n_gt_trees, 6) AS recall, ROUND(2 * "TP" / (n_pred_trees + n_gt_trees), 6) AS f1,
  ROUND("TP" / n_gt_trees, 6) AS coverage, n_gt_trees, n_pred_trees, ROUND(miou, 6) AS mean_iou_matched, ROUND((n_pred_trees - "TP") / n_gt_trees, 6) AS over_seg, ROUND((n_gt_trees - "TP") / n_gt_trees, 6) AS under_seg FROM t"""
)
def instance_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.scores(points(spark, d)), "precision", "recall", "f1", "coverage", "mean_iou_matched", "over_seg", "under_seg")


@query(
    """WITH c AS (SELECT doc_id % 5 AS plot, SUM(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS fn,
  SUM(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS tn, COUNT(*) AS n FROM labels WHERE quality IN (0, 1) GROUP BY 1)
SELECT plot, ROUND((tp + tn) / n, 6) AS sem_accuracy, ROUND(tp / GREATEST(tp + fp + fn, 1), 6) AS sem_iou_tree, ROUND(tn / GREATEST(tn + fp + fn, 1), 6) AS sem_iou_notree,
  ROUND((tp / GREATEST(tp + fp + fn, 1) + tn / GREATEST(tn + fp + fn, 1)) / 2, 6) AS sem_miou, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS sem_seg_f1, n AS sem_n_points_evaluated FROM c"""
)
def semantic_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select((F.col("doc_id") % 5).alias("plot"), F.col("quality").alias("label"), F.col("toxic").alias("semantic_pred"))
    return rounded(semantic.metrics(rows, ["plot"]), "sem_accuracy", "sem_iou_tree", "sem_iou_notree", "sem_miou", "sem_seg_f1")


@query("""WITH c AS (SELECT doc_id % 5 AS plot, SUM(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS i1, SUM(CASE WHEN quality = 1 OR toxic = 1 THEN 1 ELSE 0 END) AS u1, SUM(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS i0, SUM(CASE WHEN quality = 0 OR toxic = 0 THEN 1 ELSE 0 END) AS u0 FROM labels GROUP BY 1)
SELECT plot, ROUND((COALESCE(i1 / NULLIF(u1, 0), 0) + COALESCE(i0 / NULLIF(u0, 0), 0)) / NULLIF(CASE WHEN u1 > 0 THEN 1 ELSE 0 END + CASE WHEN u0 > 0 THEN 1 ELSE 0 END, 0), 6) AS miou FROM c""")
def batch_miou(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").withColumn("plot", F.col("doc_id") % 5)
    return rounded(semantic.batch_miou(rows, ["plot"], "quality", "toxic"), "miou")


@query("SELECT quality AS gt, toxic AS pred, COUNT(*) AS n, ROUND(COUNT(*) / GREATEST(SUM(COUNT(*)) OVER (PARTITION BY quality), 1), 6) AS share FROM labels GROUP BY quality, toxic")
def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(semantic.normalised_confusion(table(spark, d, "labels"), "quality", "toxic"), "share")


@query("SELECT doc_id % 5 AS plot, ROUND(100 * SUM(CASE WHEN quality <> toxic THEN 1 ELSE 0 END) / COUNT(*), 6) AS error_pct, ROUND(100 * SUM(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) / COUNT(*), 6) AS fp_pct, ROUND(100 * SUM(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) / COUNT(*), 6) AS fn_pct, ROUND(100 * SUM(quality) / COUNT(*), 6) AS tree_pct FROM labels GROUP BY 1")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").withColumn("plot", F.col("doc_id") % 5)
    return rounded(semantic.error_rates(rows, ["plot"], "quality", "toxic"), "error_pct", "fp_pct", "fn_pct", "tree_pct")


@query("SELECT quality AS label, COUNT(*) AS n, ROUND(SUM(COUNT(*)) OVER () / (2 * COUNT(*) + 1e-6), 6) AS weight FROM labels GROUP BY quality")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(semantic.class_weights(table(spark, d, "labels").withColumnRenamed("quality", "label").select("label")), "weight")


@query(f"{P}, c AS (SELECT plot, gt_id, SUM(CASE WHEN point_id % 5 = 0 THEN 1 ELSE 0 END) AS s FROM p GROUP BY ALL) SELECT plot, COUNT(*) AS total, CAST(SUM(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered, CAST(SUM(CASE WHEN s > 0 THEN 0 ELSE 1 END) AS BIGINT) AS uncovered, ROUND(100 * SUM(CASE WHEN s > 0 THEN 1 ELSE 0 END) / COUNT(*), 6) AS covered_pct FROM c GROUP BY plot")
def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = points(spark, d).groupBy("plot", "gt_id").agg(F.count_if(F.col("point_id") % 5 == 0).alias("n_samples"))
    return rounded(semantic.coverage(n, ["plot"]), "covered_pct")


@query(f"{P} SELECT plot, gt_id, ROUND(AVG(z / 1000), 6) AS p0, ROUND(AVG(1 - z / 1000), 6) AS p1, COUNT(*) AS n_samples, CAST(CASE WHEN AVG(1 - z / 1000) > AVG(z / 1000) THEN 1 ELSE 0 END AS INT) AS semantic_pred FROM p GROUP BY ALL")
def probability_merge(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("p0", F.col("z") / 1000).withColumn("p1", 1 - F.col("z") / 1000)
    return rounded(semantic.merge_probabilities(p, ["plot", "gt_id"]), "p0", "p1")


@query(f"{P}, b AS (SELECT plot, CAST(CASE WHEN z >= 0 AND z < 10 THEN 0 WHEN z >= 10 AND z < 50 THEN 1 WHEN z >= 50 AND z < 100 THEN 2 END AS INT) AS band FROM p) SELECT plot, band, COUNT(*) AS n, ROUND(100 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY plot), 6) AS pct FROM b WHERE band IS NOT NULL GROUP BY plot, band")
def height_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(semantic.banded(points(spark, d), ["plot"], [0.0, 10.0, 50.0, 100.0], "z"), "pct")


@query(f"{P}, s AS (SELECT plot, pred_id, COUNT(*) AS size FROM p WHERE pred_id > 0 GROUP BY ALL), e AS (SELECT MIN(size) AS lo, MAX(size) AS hi FROM s) SELECT CAST(CASE WHEN hi > lo THEN LEAST(FLOOR((size - lo) * 19 / NULLIF(hi - lo, 0)), 18) ELSE 0 END AS INT) AS bin, COUNT(*) AS n FROM s, e GROUP BY 1")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return semantic.size_histogram(points(spark, d), "pred_id")


# --- reports -------------------------------------------------------------------------------------

UNP = f"{M}, u AS (SELECT method, plot, institution, metric, value FROM (SELECT method, plot, institution, f1, recall FROM m) UNPIVOT (value FOR metric IN (f1, recall)))"


@query(f'{UNP} SELECT method, metric, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std, ROUND(MEDIAN(value), 6) AS median, ROUND(MIN(value), 6) AS "min", ROUND(MAX(value), 6) AS "max", COUNT(*) AS n FROM u GROUP BY ALL')
def descriptive_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.describe(metrics(spark, d), ["f1", "recall"]), "mean", "std", "median", "min", "max")


@query(f"{M} SELECT method, institution, ROUND(AVG(f1), 6) AS f1, ROUND(AVG(coverage), 6) AS coverage, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(n) AS BIGINT) AS n FROM m GROUP BY ALL")
def site_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.summarise(metrics(spark, d), ["method", "institution"], ["f1", "coverage"], ["tp", "n"]), "f1", "coverage")


@query(f"{M} SELECT method, ROUND(AVG(f1), 6) AS f1, CAST(SUM(tp) AS BIGINT) AS tp FROM m GROUP BY ALL")
def method_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.summarise(metrics(spark, d), ["method"], ["f1"], ["tp"]), "f1")


@query(f"{M} SELECT institution, ROUND(AVG(f1), 6) AS mean, ROUND(STDDEV_POP(f1), 6) AS std, COUNT(f1) AS n FROM m GROUP BY ALL")
def site_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.site_spread(metrics(spark, d)), "mean", "std")


LOO = f"""{M}, x AS (SELECT DISTINCT institution AS excluded_site FROM m UNION ALL SELECT 'none'),
k AS (SELECT excluded_site, COUNT(DISTINCT plot) AS n_plots FROM x JOIN m ON institution <> excluded_site GROUP BY ALL),
l AS (SELECT x.excluded_site, n_plots, method, AVG(f1) AS mean_f1, STDDEV_SAMP(f1) AS std_f1 FROM x JOIN m ON institution <> x.excluded_site JOIN k ON k.excluded_site = x.excluded_site GROUP BY ALL),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY excluded_site ORDER BY mean_f1 DESC, method) AS r FROM l)"""


@query(f"{LOO} SELECT excluded_site, n_plots AS n_plots_remaining, method, ROUND(mean_f1, 6) AS mean_f1, ROUND(std_f1, 6) AS std_f1 FROM l")
def leave_one_site_out(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.leave_one_out(metrics(spark, d)), "mean_f1", "std_f1")


@query(f"{LOO}, o AS (SELECT excluded_site, n_plots, LIST(method ORDER BY r) AS o FROM rk GROUP BY ALL) SELECT excluded_site, n_plots, o[1] AS rank_1, o[2] AS rank_2, o[3] AS rank_3, o[4] AS rank_4, COALESCE(o[5], '—') AS rank_5, o <> (SELECT o FROM o WHERE excluded_site = 'none') AS ranking_changed FROM o")
def ranking_stability(spark: SparkSession, d: str) -> DataFrame:
    return report.rank_stability(report.leave_one_out(metrics(spark, d)))


@query(
    f"""{M}, o AS (SELECT UNNEST(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS method),
s AS (SELECT method, AVG(f1) AS a, AVG(CASE WHEN institution <> 'ASIA' THEN f1 END) AS b, COUNT(DISTINCT plot) AS n1, COUNT(DISTINCT CASE WHEN institution <> 'ASIA' THEN plot END) AS n2 FROM m GROUP BY ALL)
SELECT o.method, ROUND(a, 6) AS f1_with, ROUND(b, 6) AS f1_without, ROUND(b - a, 6) AS delta, ROUND(100 * (b - a) / NULLIF(a, 0), 6) AS pct_change, n1 AS n_plots_with, n2 AS n_plots_without FROM o LEFT JOIN s ON o.method = s.method"""
)
def site_impact(spark: SparkSession, d: str) -> DataFrame:
    got = report.site_impact(metrics(spark, d), "ASIA", PRIORITIES)
    return rounded(got.withColumn("pct_change", F.when(F.col("f1_with") != 0, F.col("pct_change"))), "f1_with", "f1_without", "delta", "pct_change")


CLAIMS = {"c1": ("1-URGENT", "2-HIGH"), "c2": ("3-MEDIUM", "4-NOT SPECIFIED"), "c3": ("5-LOW", "1-URGENT")}


@query(f"{LOO}, w AS (SELECT excluded_site, " + ", ".join(f"COALESCE(MAX(CASE WHEN method = '{p}' THEN mean_f1 END), 0) AS p{i}" for i, p in enumerate(PRIORITIES)) + " FROM l GROUP BY ALL) SELECT excluded_site, p1 > p0 AS c1, p3 > p2 AS c2, p0 > p4 AS c3 FROM w")
def conclusion_checks(spark: SparkSession, d: str) -> DataFrame:
    return report.conclusions(report.leave_one_out(metrics(spark, d)), CLAIMS, "excluded_site")


@query(f"{M} SELECT institution, " + ", ".join(f"ROUND(AVG(CASE WHEN method = '{p}' THEN f1 END), 6) AS \"{p}\"" for p in PRIORITIES) + " FROM m GROUP BY institution")
def site_method_pivot(spark: SparkSession, d: str) -> DataFrame:
    return report.pivot_mean(metrics(spark, d), "institution", "method", list(PRIORITIES), "f1").select("institution", *[r6(F.col(f"`{p}`"), p) for p in PRIORITIES])


@query(f"{M}, o AS (SELECT UNNEST([0, 1, 2, 3, 4]) AS position, UNNEST(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS method) SELECT CAST(position AS INT) AS position, o.method, ROUND(AVG(f1), 6) AS f1, ROUND(AVG(recall), 6) AS recall FROM o LEFT JOIN m ON o.method = m.method GROUP BY ALL")
def ordered_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.ordered_means(metrics(spark, d), ["f1", "recall"], PRIORITIES), "f1", "recall")


@query(f"""{P}, a AS (SELECT plot, gt_id, COUNT(*) AS n, (MAX(x) - MIN(x)) * (MAX(y) - MIN(y)) AS area FROM p GROUP BY ALL HAVING (MAX(x) - MIN(x)) * (MAX(y) - MIN(y)) > 0), z AS (SELECT plot, n / area AS den FROM a)
SELECT plot AS institution, COUNT(*) AS n_plots, ROUND(MIN(den), 6) AS "min", ROUND(MEDIAN(den), 6) AS median, ROUND(MAX(den), 6) AS "max" FROM z GROUP BY plot UNION ALL SELECT 'GLOBAL', COUNT(*), ROUND(MIN(den), 6), ROUND(MEDIAN(den), 6), ROUND(MAX(den), 6) FROM z""")
def density_by_site(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(F.col("plot").alias("institution"), F.col("gt_id").alias("plot"), "x", "y")
    return rounded(report.density_by_site(p), "min", "median", "max")


@query(f"""{P} SELECT plot, COUNT(*) AS n_points, COUNT(DISTINCT CASE WHEN gt_id > 0 THEN gt_id END) AS n_trees, ROUND(MIN(z), 6) AS z_min, ROUND(MAX(z), 6) AS z_max, (MAX(x) - MIN(x)) * (MAX(y) - MIN(y)) AS area,
ROUND(COALESCE(COUNT(*) / NULLIF((MAX(x) - MIN(x)) * (MAX(y) - MIN(y)), 0), 0), 6) AS density, '' AS warnings FROM p GROUP BY plot""")
def cloud_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.profile(points(spark, d).withColumn("tree_id", F.col("gt_id")), ["plot"]), "z_min", "z_max", "density")


@query(
    """WITH s AS (SELECT n_name AS institution, COUNT(DISTINCT c_mktsegment) AS plots, COUNT(DISTINCT CASE WHEN c_custkey > 0 THEN c_mktsegment || CAST(c_custkey AS VARCHAR) END) AS trees FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20 GROUP BY 1),
e AS (SELECT n_name AS institution, 5 AS n_plots, 60 AS n_trees FROM nation WHERE n_nationkey >= 2), j AS (SELECT COALESCE(s.institution, e.institution) AS institution, CAST(COALESCE(plots, 0) AS BIGINT) AS plots, CAST(COALESCE(trees, 0) AS BIGINT) AS trees, CAST(COALESCE(plots, 0) - COALESCE(n_plots, 0) AS BIGINT) AS dp, CAST(COALESCE(trees, 0) - COALESCE(n_trees, 0) AS BIGINT) AS dt FROM s FULL JOIN e ON s.institution = e.institution)
SELECT institution, plots, trees, CASE WHEN dp = 0 THEN 'OK' ELSE 'MISMATCH(' || CASE WHEN dp > 0 THEN '+' ELSE '' END || CAST(dp AS VARCHAR) || ')' END AS plots_status, CASE WHEN dt = 0 THEN 'OK' ELSE 'MISMATCH(' || CASE WHEN dt > 0 THEN '+' ELSE '' END || CAST(dt AS VARCHAR) || ')' END AS trees_status FROM j"""
)
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    """Audit of a fixture with gaps on both sides: the cloud lacks the nations from 20 on, the expectation the first two."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n.where("n_nationkey < 20")), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.select(F.col("n_name").alias("institution"), F.col("c_mktsegment").alias("plot"), F.col("c_custkey").alias("tree_id"))
    expected = n.where("n_nationkey >= 2").select(F.col("n_name").alias("institution"), F.lit(5).alias("n_plots"), F.lit(60).alias("n_trees"))
    return report.split_audit(p, expected)


@query(f"{M} SELECT COUNT(DISTINCT CASE WHEN institution = 'ASIA' THEN plot END) AS n_site, COUNT(DISTINCT plot) AS n_all, ROUND(COUNT(DISTINCT CASE WHEN institution = 'ASIA' THEN plot END) / COUNT(DISTINCT plot), 6) AS share FROM m")
def site_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.site_share(metrics(spark, d), "ASIA"), "share")


@query(f"{M} SELECT plot, method, f1, CAST(NULL AS DOUBLE) AS sem_miou FROM (SELECT plot, method, ROUND(f1, 6) AS f1 FROM m WHERE method = '1-URGENT') UNION ALL SELECT plot, method, ROUND(f1, 6), ROUND(recall, 6) FROM m WHERE method = '2-HIGH'")
def ragged_union(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    return report.union([m.where("method = '1-URGENT'").select("plot", "method", r6("f1")), m.where("method = '2-HIGH'").select("plot", "method", r6("f1"), r6("recall", "sem_miou"))])


@query(f"{M} SELECT plot, method, ROUND(f1, 6) AS f1 FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY plot ORDER BY f1 DESC, method) = 1")
def best_method(spark: SparkSession, d: str) -> DataFrame:
    return report.first_best(metrics(spark, d).select("plot", "method", "f1"), "f1", ["method"], ["plot"]).select("plot", "method", r6("f1"))


COMBO = "c AS (SELECT v.v AS voxel, s.s AS sigma FROM (SELECT UNNEST([1, 2, 3]) AS v) v, (SELECT UNNEST([3, 5, 10]) AS s) s), g AS (SELECT voxel, sigma, AVG((f1 * voxel + recall * sigma) / (voxel + sigma)) AS mean_f1, STDDEV_POP((f1 * voxel + recall * sigma) / (voxel + sigma)) AS std_f1, COUNT(*) AS n_plots FROM c, m GROUP BY ALL)"


def _combos(spark: SparkSession, d: str) -> DataFrame:
    grid = {"voxel": (1.0, 2.0, 3.0), "sigma": (3.0, 5.0, 10.0)}
    rows = [(i, *c.values()) for i, c in enumerate(gridsearch.combinations(grid))]
    params = spark.createDataFrame(rows, "combo long, voxel double, sigma double")
    scored = metrics(spark, d).join(F.broadcast(params)).select("plot", "combo", ((F.col("f1") * F.col("voxel") + F.col("recall") * F.col("sigma")) / (F.col("voxel") + F.col("sigma"))).alias("f1"))
    return gridsearch.summarise(scored, grid)


@query(f"{M}, {COMBO} SELECT CAST(ROW_NUMBER() OVER (ORDER BY voxel, sigma) - 1 AS BIGINT) AS combo, CAST(voxel AS DOUBLE) AS voxel, CAST(sigma AS DOUBLE) AS sigma, ROUND(mean_f1, 6) AS mean_f1, ROUND(std_f1, 6) AS std_f1, n_plots FROM g")
def grid_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_combos(spark, d), "mean_f1", "std_f1")


@query(f"{M}, {COMBO}, t AS (SELECT sigma, ROUND(MAX(mean_f1), 6) AS best FROM g GROUP BY sigma) SELECT CAST(sigma AS DOUBLE) AS sigma, best, ROW_NUMBER() OVER (ORDER BY best DESC, sigma) = 1 AS chosen FROM t")
def marginal_best(spark: SparkSession, d: str) -> DataFrame:
    return report.marginal_best(rounded(_combos(spark, d), "mean_f1"), "sigma")


@query(f"{M} SELECT plot, method, CASE method WHEN '1-URGENT' THEN 'none' WHEN '2-HIGH' THEN 'rf' ELSE 'other' END AS preproc, REPLACE(STR_SPLIT(plot, ':')[1], '_', ' ') AS label FROM m")
def value_mapping(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("plot", "method", labels.mapped("method", {"1-URGENT": "none", "2-HIGH": "rf"}, "other").alias("preproc"), labels.pretty("plot").alias("label"))


# --- statistics ----------------------------------------------------------------------------------

NAMED = dict(zip(METHODS, PRIORITIES, strict=True))
PAIRED = tuple((NAMED[a], NAMED[b]) for a, b in COMPARISONS)


def flips_sql(by: str, source: str) -> str:
    """CTE ``flips`` (by, n, observed, n_permutations, p_value) of the differences ``source`` (by, i from 0, n, d): the signed sums of both halves meet."""

    def half(name: str, which: str) -> str:
        # a recursion over the positions of one half doubles its sums at each step
        return f"""{name}0 AS MATERIALIZED (SELECT {by}, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY i) AS k, d FROM {source} WHERE {which}),
{name}(g, k, s) AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM {source} UNION ALL SELECT g, {name}.k + 1, s + e.t * h.d FROM {name} JOIN {name}0 h ON h.{by} = g AND h.k = {name}.k + 1, (VALUES (1), (-1)) e(t)),
{name}1 AS MATERIALIZED (SELECT g, s FROM {name} QUALIFY k = MAX(k) OVER (PARTITION BY g))"""

    return f"""{half("fa", "i < n // 2")}, {half("fb", "i >= n // 2")},
fo AS MATERIALIZED (SELECT {by}, AVG(d) AS observed, MAX(n) AS n FROM {source} GROUP BY {by}),
flips AS MATERIALIZED (SELECT fo.{by}, n, observed, CAST(POW(2, n) AS BIGINT) AS n_permutations, SUM(CASE WHEN ABS(a.s + b.s) / n >= ABS(observed) - 1e-12 THEN 1 ELSE 0 END) / POW(2, n) AS p_value FROM fo JOIN fa1 a ON a.g = fo.{by} JOIN fb1 b ON b.g = fo.{by} GROUP BY fo.{by}, n, observed)"""


def ranks_sql(by: str, source: str) -> str:
    """CTE ``signed`` (by, n_plots, n_nonzero_pairs, W, p_wilcoxon): how many subsets of the ranks have each sum, rank by rank."""
    return f"""nz AS MATERIALIZED (SELECT {by}, i, d, 2 * RANK() OVER (PARTITION BY {by} ORDER BY ABS(d)) + COUNT(*) OVER (PARTITION BY {by}, ABS(d)) - 1 AS r FROM {source} WHERE d <> 0),
nk AS MATERIALIZED (SELECT {by}, r, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY r, i) AS k FROM nz),
ways(g, k, s, c) AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM nz UNION ALL SELECT g, k, s, SUM(c) FROM (SELECT g, ways.k + 1 AS k, CAST(s + e.t * n.r AS BIGINT) AS s, c FROM ways JOIN nk n ON n.{by} = g AND n.k = ways.k + 1, (VALUES (0), (1)) e(t)) GROUP BY g, k, s),
last AS MATERIALIZED (SELECT * FROM ways QUALIFY k = MAX(k) OVER (PARTITION BY g)),
w2 AS (SELECT {by}, LEAST(SUM(CASE WHEN d > 0 THEN r ELSE 0 END), SUM(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, COUNT(*) AS k FROM nz GROUP BY {by}),
wp AS (SELECT w2.{by}, w / 2 AS "W", LEAST(1, 2 * SUM(CASE WHEN s <= w THEN c ELSE 0 END) / SUM(c)) AS p_wilcoxon FROM w2 JOIN last ON g = w2.{by} WHERE w2.k >= 2 GROUP BY w2.{by}, w),
wn AS (SELECT {by}, COUNT(*) AS n_plots, CAST(SUM(CASE WHEN d <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero_pairs FROM {source} GROUP BY {by}),
signed AS (SELECT wn.{by}, n_plots, n_nonzero_pairs, "W", p_wilcoxon, CASE WHEN n_nonzero_pairs < 2 THEN 'too few non-zero pairs' ELSE '' END AS note FROM wn LEFT JOIN wp ON wn.{by} = wp.{by})"""


DIFF = f"""{RM}, dd AS MATERIALIZED (SELECT a.plot, a.institution, 'all' AS comparison, ROUND(b.f1 - a.f1, 9) AS d FROM m a JOIN m b ON a.plot = b.plot WHERE a.method = '1-URGENT' AND b.method = '2-HIGH'),
df AS MATERIALIZED (SELECT comparison, d, ROW_NUMBER() OVER (ORDER BY plot) - 1 AS i, COUNT(*) OVER () AS n FROM dd)"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.paired(metrics(spark, d), "1-URGENT", "2-HIGH").withColumn("d", F.round("d", 9))
    return rows.withColumn("comparison", F.lit("all"))


@query(f"{DIFF}, {flips_sql('comparison', 'df')} SELECT n, ROUND(observed, 6) AS observed, n_permutations, ROUND(p_value, 6) AS p_value FROM flips")
def sign_flip_test(spark: SparkSession, d: str) -> DataFrame:
    got = stats.sign_flip_test(_diffs(spark, d), ["comparison"]).select("n", "observed", "n_permutations", "p_value")
    return rounded(got, "observed", "p_value")


@query(f"{DIFF}, {ranks_sql('comparison', 'df')} SELECT n_plots, n_nonzero_pairs, ROUND(\"W\", 6) AS \"W\", ROUND(p_wilcoxon, 6) AS p_wilcoxon FROM signed")
def signed_rank_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.wilcoxon(_diffs(spark, d), ["comparison"]).select("n_plots", "n_nonzero_pairs", "W", "p_wilcoxon"), "W", "p_wilcoxon")


@query(f"{DIFF} SELECT institution, COUNT(*) AS n, ROUND(AVG(d), 6) AS mean_diff, ROUND(STDDEV_SAMP(d), 6) AS std_diff FROM dd GROUP BY ALL")
def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    rows = stats.paired(m, "1-URGENT", "2-HIGH").withColumn("d", F.round("d", 9)).join(m.select("plot", "institution").distinct(), "plot")
    return rows.groupBy("institution").agg(F.count("*").alias("n"), r6(F.avg("d"), "mean_diff"), r6(F.stddev_samp("d"), "std_diff"))


# --- sampling, parsing, vectors, kernels -----------------------------------------------------------


@query(f"{P} SELECT plot, classification, point_id FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY plot, classification ORDER BY (point_id * 7919) % 10007, point_id) <= 10")
def capped_sample(spark: SparkSession, d: str) -> DataFrame:
    order = (F.col("point_id") * 7919) % 10007
    return sampling.cap_per_class(points(spark, d), 10, ("plot", "classification"), order=order).select("plot", "classification", "point_id")


@query(f"SELECT n_name AS plot, CASE WHEN ROW_NUMBER() OVER (ORDER BY {draw_sql(42, 'n_name')}, n_name) <= CEIL(0.2 * COUNT(*) OVER ()) THEN 'val' ELSE 'train' END AS split FROM nation")
def plot_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_plots(table(spark, d, "nation").select(F.col("n_name").alias("plot")))


@query("SELECT CAST(event_id AS INT) AS epoch, 100 AS epochs, ROUND(CAST(event_id % 97 AS DOUBLE) / 100, 6) AS train_loss, ROUND(CAST(event_id % 89 AS DOUBLE) / 100, 6) AS miou FROM events WHERE event_id % 2 = 0")
def training_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    number = lambda m: F.format_string("%.2f", (F.col("event_id") % m) / 100)
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Epoch "), F.col("event_id"), F.lit("/100 | Train Loss: "), number(97), F.lit(" | Val mIoU: "), number(89))).otherwise("saved checkpoint")
    return rounded(tables.parse_log(e.select(line.alias("value"))), "train_loss", "miou")


@query("SELECT a.vec_id, ROUND(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(a.embedding, b.embedding), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) * (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)))), 6) AS d2, CAST(LIST_POSITION(a.embedding, LIST_MAX(a.embedding)) - 1 AS INT) AS top FROM embeddings a JOIN embeddings b ON b.vec_id = (SELECT MIN(vec_id) FROM embeddings)")
def vector_distance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    # one row
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b"))
    return e.join(F.broadcast(first)).select("vec_id", r6(squared_distance("embedding", "b"), "d2"), argmax("embedding").alias("top"))


@query()
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """All 36 and 108 combinations of both seedings, in the units of these tables."""
    scale = {"voxel_size": 200.0, "gaussian_sigma": 1.0, "min_crown_radius_m": 40.0, "top_band_m": 20.0}
    base, found = Watershed(min_tree_height=40.0, min_points_per_tree=5), []
    for method, seeding, grid in (("rf", "chm", gridsearch.GRID), ("rf_density", "density", gridsearch.GRID_DENSITY)):
        wide = {k: tuple(v * scale[k] for v in values) for k, values in grid.items()}
        scored = gridsearch.score_plots(points(spark, d), seeding, wide, base, axes=("x", "y", "z"))
        found.append(gridsearch.summarise(scored, wide).withColumn("method", F.lit(method)))
    return report.union(found)


@query(f"{M} SELECT plot, 'both' AS side FROM (SELECT plot FROM m WHERE method = '1-URGENT' AND f1 > 0.33 INTERSECT SELECT plot FROM m WHERE method = '2-HIGH' AND f1 > 0.33) UNION ALL SELECT plot, 'first' FROM (SELECT plot FROM m WHERE method = '1-URGENT' AND f1 > 0.33 EXCEPT SELECT plot FROM m WHERE method = '2-HIGH' AND f1 > 0.33)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).where("f1 > 0.33")
    a, b = (m.where(F.col("method") == x).select("plot") for x in PRIORITIES[:2])
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("first")))


@query(f"{M} SELECT DISTINCT plot FROM m WHERE plot NOT IN (SELECT plot FROM m WHERE method = '3-MEDIUM' AND f1 > 0.33)")
def plots_to_resume(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    return tables.missing_plots(m.select("plot").distinct(), m.where("f1 > 0.33"), "3-MEDIUM")


@query(f"{M} SELECT method, ROUND(CASE WHEN method = '2-HIGH' THEN AVG(recall) ELSE AVG(f1) END, 6) AS mean_f1 FROM m GROUP BY method")
def best_params_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).groupBy("method").agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"))
    return rounded(tables.upsert_best(m.select("method", F.col("f1").alias("mean_f1")), m.where("method = '2-HIGH'").select("method", F.col("recall").alias("mean_f1"))), "mean_f1")


@query(f"{P} SELECT plot, CAST(LEAST(1000, GREATEST(50, FLOOR(3 * COUNT(*) / 64))) AS INT) AS passes FROM p GROUP BY plot")
def inference_passes(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("plot").agg(F.count("*").alias("n")).select("plot", sampling.passes(F.col("n"), 64).alias("passes"))


@query(
    f"""{P}, c AS (SELECT plot, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM p GROUP BY plot), q AS (SELECT p.plot, point_id, x - mx AS x, y - my AS y, z - mz AS z FROM p JOIN c ON p.plot = c.plot),
f AS (SELECT plot, MAX(SQRT(x * x + y * y + z * z)) AS far FROM q GROUP BY plot) SELECT q.plot, point_id, ROUND(x / (far + 1e-8), 6) + 0.0 AS x, ROUND(y / (far + 1e-8), 6) + 0.0 AS y, ROUND(z / (far + 1e-8), 6) + 0.0 AS z FROM q JOIN f ON q.plot = f.plot"""
)
def normalised_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = sampling.block_normalised(points(spark, d)).select("plot", "point_id", "x", "y", "z")
    return b.withColumns({a: F.round(F.col(a), 6) + 0.0 for a in ("x", "y", "z")})


@query(
    f"""{RM}, u AS (SELECT plot, method, metric, value FROM (SELECT plot, method, f1, "precision", recall FROM m) UNPIVOT (value FOR metric IN (f1, "precision", recall))),
c AS (SELECT UNNEST({[a for a, _ in PAIRED]}) AS method_a, UNNEST({[b for _, b in PAIRED]}) AS method_b),
df AS MATERIALIZED (SELECT method_a || ' -> ' || method_b || '|' || a.metric AS test, method_a, method_b, a.metric, a.plot, ROUND(b.value - a.value, 9) AS d, ROW_NUMBER() OVER (PARTITION BY method_a, method_b, a.metric ORDER BY a.plot) - 1 AS i, COUNT(*) OVER (PARTITION BY method_a, method_b, a.metric) AS n
  FROM c JOIN u a ON a.method = method_a JOIN u b ON b.method = method_b AND a.plot = b.plot AND a.metric = b.metric),
{flips_sql("test", "df")}, {ranks_sql("test", "df")},
g AS (SELECT test, method_a, method_b, metric, AVG(d) AS mean_diff, STDDEV_SAMP(d) AS std_diff FROM df GROUP BY ALL)
SELECT method_a || ' -> ' || method_b AS comparison, method_a, method_b, metric, n_plots, n_nonzero_pairs, ROUND("W", 6) AS "W", ROUND(p_wilcoxon, 6) AS p_wilcoxon, note, ROUND(mean_diff, 6) + 0.0 AS mean_diff, ROUND(std_diff, 6) AS std_diff,
  ROUND(observed, 6) + 0.0 AS perm_observed_diff, ROUND(p_value, 6) AS perm_p_value, n_permutations FROM g JOIN flips ON flips.test = g.test JOIN signed ON signed.test = g.test"""
)
def paired_table(spark: SparkSession, d: str) -> DataFrame:
    got = rounded(stats.paired_table(metrics(spark, d), comparisons=PAIRED), "W", "p_wilcoxon", "mean_diff", "std_diff", "perm_observed_diff", "perm_p_value")
    return got.withColumns({n: F.col(n) + 0.0 for n in ("mean_diff", "perm_observed_diff")})


@query(f"{P}, s AS (SELECT plot, pred_id, COUNT(*) AS n FROM p WHERE plot LIKE '%ur%' AND pred_id > 0 GROUP BY ALL) SELECT plot, pred_id, n FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY plot ORDER BY n DESC, pred_id) <= 3")
def largest_segments(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = labels.plots_like(points(spark, d), "ur").where("pred_id > 0").groupBy("plot", "pred_id").agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(W.partitionBy("plot").orderBy(F.desc("n"), "pred_id"))).where("_r <= 3").drop("_r")


# modules that register queries of their own
from stemline.plans import forests, kernels, networks, stored  # noqa: E402, F401
