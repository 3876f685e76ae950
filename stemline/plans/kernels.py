"""Registered queries of kernels: terrain, smoothing, seeds, features, samples, intervals and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.config import COMPARISONS, METHODS, Blocks, Config, Terrain, Watershed
from stemline.functions.guards import clamp
from stemline.functions.normal import normal_cdf, normal_ppf
from stemline.operators import farthest, features, gridsearch, labels, matching, ml, neighbors, raster, report, sampling, segment, semantic, stats, triangles, voxel
from stemline.plans import flows
from stemline.plans.projections import metrics, points, table
from stemline.plans.registry import LABEL, PRIORITIES, RM, RP, M, P, draw_sql, index_sql, query, r6, rounded

# --- terrain ---------------------------------------------------------------------------------------


def kernel_sql(sigma: float) -> str:
    w = raster.kernel(sigma)
    return "(VALUES " + ", ".join(f"({k - len(w) // 2}, CAST({float(x)!r} AS DOUBLE))" for k, x in enumerate(w)) + ") k(o, w)"


def mirrored(at: str, n: str) -> str:
    """An index past a border, sent back; the edge cell is repeated."""
    m = f"(((({at}) % (2 * {n})) + 2 * {n}) % (2 * {n}))"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END"


def grid_sql(size: float) -> str:
    return f"""{P}, e AS MATERIALIZED (SELECT plot, MIN(x) AS x0, MIN(y) AS y0, CAST(GREATEST(CEIL((MAX(x) + {size} - MIN(x)) / {size}) - 1, 1) AS BIGINT) AS nx, CAST(GREATEST(CEIL((MAX(y) + {size} - MIN(y)) / {size}) - 1, 1) AS BIGINT) AS ny FROM p GROUP BY plot),
g AS MATERIALIZED (SELECT p.plot, CAST(LEAST(GREATEST(FLOOR((x - x0) / {size}), 0), nx - 1) AS BIGINT) AS ix, CAST(LEAST(GREATEST(FLOOR((y - y0) / {size}), 0), ny - 1) AS BIGINT) AS iy, MEDIAN(z) AS z FROM p JOIN e ON p.plot = e.plot WHERE classification = 2 GROUP BY ALL),
c AS MATERIALIZED (SELECT e.plot, i.ix, j.iy FROM e, LATERAL (SELECT UNNEST(RANGE(nx)) AS ix) i, LATERAL (SELECT UNNEST(RANGE(ny)) AS iy) j),"""


#: the interpolation along rows and columns
LINES = """lx AS (SELECT c.plot, c.ix, c.iy, MAX(CASE WHEN g.ix <= c.ix THEN g.ix END) AS lo, MIN(CASE WHEN g.ix >= c.ix THEN g.ix END) AS hi FROM c JOIN g ON g.plot = c.plot AND g.iy = c.iy GROUP BY ALL),
ly AS (SELECT c.plot, c.ix, c.iy, MAX(CASE WHEN g.iy <= c.iy THEN g.iy END) AS lo, MIN(CASE WHEN g.iy >= c.iy THEN g.iy END) AS hi FROM c JOIN g ON g.plot = c.plot AND g.ix = c.ix GROUP BY ALL),
vx AS (SELECT l.plot, l.ix, l.iy, CASE WHEN lo = hi THEN a.z WHEN a.z IS NOT NULL AND b.z IS NOT NULL THEN a.z + (b.z - a.z) * (l.ix - lo) / (hi - lo) ELSE COALESCE(a.z, b.z) END AS v, 1 / GREATEST(0.5, LEAST(l.ix - lo, hi - l.ix)) AS w
  FROM lx l LEFT JOIN g a ON a.plot = l.plot AND a.iy = l.iy AND a.ix = lo LEFT JOIN g b ON b.plot = l.plot AND b.iy = l.iy AND b.ix = hi),
vy AS (SELECT l.plot, l.ix, l.iy, CASE WHEN lo = hi THEN a.z WHEN a.z IS NOT NULL AND b.z IS NOT NULL THEN a.z + (b.z - a.z) * (l.iy - lo) / (hi - lo) ELSE COALESCE(a.z, b.z) END AS v, 1 / GREATEST(0.5, LEAST(l.iy - lo, hi - l.iy)) AS w
  FROM ly l LEFT JOIN g a ON a.plot = l.plot AND a.ix = l.ix AND a.iy = lo LEFT JOIN g b ON b.plot = l.plot AND b.ix = l.ix AND b.iy = hi),
ff AS (SELECT c.plot, c.ix, c.iy, CASE WHEN g.z IS NOT NULL THEN g.z WHEN vx.w IS NULL AND vy.w IS NULL THEN NULL ELSE (COALESCE(vx.v * vx.w, 0) + COALESCE(vy.v * vy.w, 0)) / (COALESCE(vx.w, 0) + COALESCE(vy.w, 0)) END AS z
  FROM c LEFT JOIN g ON g.plot = c.plot AND g.ix = c.ix AND g.iy = c.iy LEFT JOIN vx ON vx.plot = c.plot AND vx.ix = c.ix AND vx.iy = c.iy LEFT JOIN vy ON vy.plot = c.plot AND vy.ix = c.ix AND vy.iy = c.iy)"""

# An edge (a, b) of the outline of an empty circle's cells, the circle on its left: of the cells to the left none has a lower
# parameter on the edge's bisector than the circle's, those to the right all have one, none lies between the ends.  With the circle's first cell it makes one triangle.
TRIANGLES = """th AS (SELECT a.plot, a.ix AS ax, a.iy AS ay, a.z AS az, b.ix AS bx, b.iy AS cy, b.z AS bz, c.ix AS ux, c.iy AS uy, (b.ix - a.ix) * (c.iy - a.iy) - (b.iy - a.iy) * (c.ix - a.ix) AS k, (c.ix - a.ix) * (c.ix - b.ix) + (c.iy - a.iy) * (c.iy - b.iy) AS d
  FROM g a JOIN g b ON b.plot = a.plot AND (a.ix <> b.ix OR a.iy <> b.iy) JOIN g c ON c.plot = a.plot AND (c.ix <> a.ix OR c.iy <> a.iy) AND (c.ix <> b.ix OR c.iy <> b.iy)),
ed AS (SELECT plot, ax, ay, bx, cy, ANY_VALUE(az) AS az, ANY_VALUE(bz) AS bz, MIN(CASE WHEN k > 0 THEN {'s': d / k, 'y': uy, 'x': ux} END) AS m, MAX(CASE WHEN k < 0 THEN d / k END) AS r, BOOL_OR(k = 0 AND d < 0) AS cut FROM th GROUP BY plot, ax, ay, bx, cy),
tr AS MATERIALIZED (SELECT ed.plot, ax, ay, az, bx, cy, bz, g.ix AS lx, g.iy AS ly, g.z AS lz FROM ed JOIN g ON g.plot = ed.plot AND g.ix = m.x AND g.iy = m.y WHERE NOT cut AND (r IS NULL OR r < m.s) AND (m.y < ay OR (m.y = ay AND m.x < ax)) AND (m.y < cy OR (m.y = cy AND m.x < bx))),
em AS (SELECT c.plot, c.ix, c.iy FROM c ANTI JOIN g ON g.plot = c.plot AND g.ix = c.ix AND g.iy = c.iy),
wt AS (SELECT em.plot, em.ix, em.iy, az, bz, lz, (bx - em.ix) * (ly - em.iy) - (cy - em.iy) * (lx - em.ix) AS wa, (lx - em.ix) * (ay - em.iy) - (ly - em.iy) * (ax - em.ix) AS wb, (ax - em.ix) * (cy - em.iy) - (ay - em.iy) * (bx - em.ix) AS wl FROM em JOIN tr ON tr.plot = em.plot),
tv AS (SELECT plot, ix, iy, MIN((wa * az + wb * bz + wl * lz) / (wa + wb + wl)) AS z FROM wt WHERE wa >= 0 AND wb >= 0 AND wl >= 0 GROUP BY ALL),
ff AS (SELECT c.plot, c.ix, c.iy, COALESCE(g.z, tv.z) AS z FROM c LEFT JOIN g ON g.plot = c.plot AND g.ix = c.ix AND g.iy = c.iy LEFT JOIN tv ON tv.plot = c.plot AND tv.ix = c.ix AND tv.iy = c.iy)"""

NEAREST = """f AS MATERIALIZED (SELECT plot, ix, iy, z FROM ff WHERE z IS NOT NULL UNION ALL
  SELECT h.plot, h.ix, h.iy, g.z FROM ff h JOIN g ON g.plot = h.plot WHERE h.z IS NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY h.plot, h.ix, h.iy ORDER BY (g.ix - h.ix) ** 2 + (g.iy - h.iy) ** 2, g.iy, g.ix) = 1)"""


def terrain_sql(gaps: str) -> str:
    return f"""{grid_sql(50.0)}
{gaps},
{NEAREST},
s1 AS MATERIALIZED (SELECT c.plot, c.ix, c.iy, SUM(k.w * f.z) AS z FROM c JOIN e ON e.plot = c.plot, {kernel_sql(2.5)} JOIN f ON f.plot = c.plot AND f.ix = c.ix AND f.iy = {mirrored("c.iy + k.o", "e.ny")} GROUP BY ALL),
s AS MATERIALIZED (SELECT c.plot, c.ix, c.iy, SUM(k.w * f.z) AS z FROM c JOIN e ON e.plot = c.plot, {kernel_sql(2.5)} JOIN s1 f ON f.plot = c.plot AND f.iy = c.iy AND f.ix = {mirrored("c.ix + k.o", "e.nx")} GROUP BY ALL),
q AS (SELECT p.plot, point_id, classification, gt_id, z, (x - x0) / 50.0 - 0.5 AS fx, (y - y0) / 50.0 - 0.5 AS fy, nx, ny FROM p JOIN e ON p.plot = e.plot),
o AS (SELECT *, CAST(GREATEST(LEAST(FLOOR(fx), nx - 2), 0) AS BIGINT) AS ix, CAST(GREATEST(LEAST(FLOOR(fy), ny - 2), 0) AS BIGINT) AS iy FROM q),
hag AS MATERIALIZED (SELECT o.plot, point_id, classification, GREATEST(0, LEAST(500, o.z - ((a.z * (1 - fx + o.ix) + b.z * (fx - o.ix)) * (1 - fy + o.iy) + (u.z * (1 - fx + o.ix) + v.z * (fx - o.ix)) * (fy - o.iy)))) AS hag
  FROM o JOIN s a ON a.plot = o.plot AND a.ix = o.ix AND a.iy = o.iy JOIN s b ON b.plot = o.plot AND b.ix = LEAST(o.ix + 1, nx - 1) AND b.iy = o.iy
  JOIN s u ON u.plot = o.plot AND u.ix = o.ix AND u.iy = LEAST(o.iy + 1, ny - 1) JOIN s v ON v.plot = o.plot AND v.ix = LEAST(o.ix + 1, nx - 1) AND v.iy = LEAST(o.iy + 1, ny - 1))"""


TERRAIN = terrain_sql(TRIANGLES)


def _heights(spark: SparkSession, d: str) -> DataFrame:
    return raster.heights(points(spark, d), 50.0, 5, 0.0, 500.0)


@query(f"{terrain_sql(LINES)} SELECT plot, ix, iy, ROUND(z, 6) AS z FROM s")
def terrain_surface(spark: SparkSession, d: str) -> DataFrame:
    return raster.surface(points(spark, d), 50.0, 5, gaps="lines").select("plot", "ix", "iy", r6("z00", "z"))


@query(f"{grid_sql(5.0)} {TRIANGLES}, {NEAREST} SELECT plot, ix, iy, ROUND(z, 6) AS z FROM f")
def terrain_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of a finer grid, about half of them empty, filled over the triangulation."""
    return triangles.fill(raster.dense_cells(points(spark, d), 5.0)).select("plot", "ix", "iy", r6("z"))


@query(f"{TERRAIN} SELECT plot, point_id, ROUND(CAST(hag AS DOUBLE), 3) AS hag FROM hag")
def terrain_heights(spark: SparkSession, d: str) -> DataFrame:
    on = raster.bilinear(points(spark, d), raster.surface(points(spark, d), 50.0, 5), raster.extents(points(spark, d), 50.0), 50.0)
    return on.select("plot", "point_id", F.round(clamp(F.col("z") - F.col("ground"), 0.0, 500.0), 3).alias("hag"))


@query(f"""{TERRAIN}, h AS (SELECT plot, {LABEL} AS label, CAST(hag AS FLOAT) AS hag FROM hag)
SELECT plot, ROUND(CAST(MIN(hag) AS DOUBLE), 2) AS hag_min, ROUND(CAST(MAX(hag) AS DOUBLE), 2) AS hag_max, ROUND(100 * SUM(CASE WHEN label <> -1 AND hag > 0 THEN 1 ELSE 0 END) / SUM(CASE WHEN label <> -1 THEN 1 ELSE 0 END), 6) AS above_pct,
  ROUND(AVG(CASE WHEN label = 1 THEN CAST(hag AS DOUBLE) END), 3) AS tree_hag FROM h GROUP BY plot""")
def height_summary(spark: SparkSession, d: str) -> DataFrame:
    got = raster.height_summary(_heights(spark, d).withColumn("label", labels.binary_label()))
    digits = {"hag_min": 2, "hag_max": 2, "above_pct": 6, "tree_hag": 3}
    return got.select("plot", *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in digits.items()])


# --- smoothing and seeds ---------------------------------------------------------------------------

def voxels_sql(size: float) -> str:
    return f"""o AS (SELECT plot, MIN(x) AS x0, MIN(y) AS y0, MIN(z) AS z0 FROM p GROUP BY plot),
v AS MATERIALIZED (SELECT p.plot, CAST(FLOOR((x - x0) / {size!r}) AS INT) AS vi, CAST(FLOOR((y - y0) / {size!r}) AS INT) AS vj, CAST(FLOOR((z - z0) / {size!r}) AS INT) AS vk, COUNT(*) AS n FROM p JOIN o ON p.plot = o.plot GROUP BY ALL),
b AS MATERIALIZED (SELECT plot, MAX(vi) + 1 AS ni, MAX(vj) + 1 AS nj, MAX(vk) + 1 AS nk FROM v GROUP BY plot)"""


VOX20 = voxels_sql(20.0)


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    return voxel.counts(voxel.voxelise(points(spark, d), 20.0, axes=("x", "y", "z")))


def smoothed_sql(source: str, value: str, axes: dict[str, str], sigma: float) -> str:
    """CTEs t0, t1, ...: a gather along each axis in turn, over the dense box b."""
    dense = ", ".join(f"LATERAL (SELECT UNNEST(RANGE({n})) AS {a}) u{a}" for a, n in axes.items())
    out = [f"t0 AS MATERIALIZED (SELECT b.plot, {', '.join(f'u{a}.{a}' for a in axes)}, COALESCE(s.{value}, 0) AS d FROM b, {dense} LEFT JOIN {source} s ON s.plot = b.plot AND " + " AND ".join(f"s.{a} = u{a}.{a}" for a in axes) + ")"]
    for k, axis in enumerate(axes):
        same = " AND ".join(f"f.{a} = {mirrored(f'c.{a} + k.o', f'b.{axes[a]}') if a == axis else f'c.{a}'}" for a in axes)
        out.append(f"t{k + 1} AS MATERIALIZED (SELECT c.plot, {', '.join(f'c.{a}' for a in axes)}, SUM(k.w * f.d) AS d FROM t{k} c JOIN b ON b.plot = c.plot, {kernel_sql(sigma)} JOIN t{k} f ON f.plot = c.plot AND {same} GROUP BY ALL)")
    return ", ".join(out)


@query(f"{P}, {VOX20}, {smoothed_sql('v', 'n', {'vi': 'ni', 'vj': 'nj', 'vk': 'nk'}, 0.5)} SELECT plot, CAST(vi AS INT) AS vi, CAST(vj AS INT) AS vj, CAST(vk AS INT) AS vk, ROUND(d, 6) AS density FROM t3 WHERE ROUND(d, 6) > 0")
def sparse_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(voxel.smooth(_voxels(spark, d), 0.5), "density").where("density > 0")


@query(
    f"""{P}, {VOX20}, top AS (SELECT plot, vi, vj, MAX(vk) AS tk FROM v GROUP BY ALL), band AS MATERIALIZED (SELECT v.plot, v.vi, v.vj, SUM(n) AS n FROM v JOIN top t ON t.plot = v.plot AND t.vi = v.vi AND t.vj = v.vj WHERE vk >= GREATEST(tk - 3, 0) GROUP BY ALL),
{smoothed_sql("band", "n", {"vi": "ni", "vj": "nj"}, 1.0)} SELECT plot, CAST(vi AS INT) AS vi, CAST(vj AS INT) AS vj, ROUND(d, 6) AS density FROM t2 WHERE ROUND(d, 6) > 0"""
)
def surface_smoothing(spark: SparkSession, d: str) -> DataFrame:
    band = voxel.top_band(_voxels(spark, d), 3)
    return rounded(voxel.smooth(band, 1.0, value="surface", axes=("vi", "vj")), "density").where("density > 0")


def peaks_sql(surface: str, accept: str, d: int = 2) -> str:
    """CTEs from ``surface`` (plot, vi, vj, tk, s) to ``every`` (plot, m, vi, vj, vk): local maxima in squares of half-width d, by falling s."""
    return f"""pk AS MATERIALIZED (SELECT plot, vi, vj, tk, ROW_NUMBER() OVER (PARTITION BY plot ORDER BY s DESC, vi, vj) AS r FROM {surface} t WHERE s > 0 AND {accept} NOT EXISTS (SELECT 1 FROM {surface} h WHERE h.plot = t.plot AND ABS(h.vi - t.vi) <= {d} AND ABS(h.vj - t.vj) <= {d} AND h.s > t.s)),
w(plot, r, taken) AS (SELECT DISTINCT plot, CAST(0 AS BIGINT), CAST([] AS STRUCT(i INT, j INT, k INT)[]) FROM pk UNION ALL
  SELECT w.plot, w.r + 1, CASE WHEN LEN(LIST_FILTER(taken, lambda x: ABS(x.i - c.vi) <= {d} AND ABS(x.j - c.vj) <= {d})) = 0 THEN LIST_APPEND(taken, {{'i': c.vi, 'j': c.vj, 'k': c.tk}}) ELSE taken END FROM w JOIN pk c ON c.plot = w.plot AND c.r = w.r + 1),
l AS (SELECT plot, taken FROM w QUALIFY r = MAX(r) OVER (PARTITION BY plot)), u AS (SELECT plot, UNNEST(RANGE(1, LEN(taken) + 1)) AS m, taken FROM l),
every AS (SELECT plot, m, taken[m].i AS vi, taken[m].j AS vj, taken[m].k AS vk FROM u)"""


def markers_sql(seeding: str, size: float, sigma: float, d: int, band: int, height: float) -> str:
    """CTEs from points p to ``markers`` (plot, marker, vi, vj, vk); density seeding needs the smoothed volume t3 before it."""
    if seeding == "chm":
        return f"su AS MATERIALIZED (SELECT plot, vi, vj, MAX(vk) AS tk, MAX(vk) * {size!r} AS s FROM v GROUP BY ALL), {peaks_sql('su', f's > {height!r} AND', d)}, markers AS MATERIALIZED (SELECT plot, m AS marker, vi, vj, vk FROM every)"
    raised = smoothed_sql("cs", "s", {"vi": "ni", "vj": "nj"}, sigma).replace("t0 ", "r0 ").replace("t1 ", "r1 ").replace("t2 ", "r2 ")
    return f"""tp AS MATERIALIZED (SELECT plot, vi, vj, MAX(vk) AS tk FROM v GROUP BY ALL),
cs AS MATERIALIZED (SELECT tp.plot, tp.vi, tp.vj, SUM(ROUND(t3.d, 9)) AS s FROM tp JOIN t3 ON t3.plot = tp.plot AND t3.vi = tp.vi AND t3.vj = tp.vj AND t3.vk BETWEEN GREATEST(tk - {band}, 0) AND tk GROUP BY ALL), {raised},
su AS MATERIALIZED (SELECT r2.plot, r2.vi, r2.vj, COALESCE(tk, 0) AS tk, ROUND(r2.d, 9) AS s FROM r2 LEFT JOIN tp ON tp.plot = r2.plot AND tp.vi = r2.vi AND tp.vj = r2.vj), {peaks_sql("su", "", d)},
markers AS MATERIALIZED (SELECT plot, ROW_NUMBER() OVER (PARTITION BY plot ORDER BY m) AS marker, vi, vj, vk FROM every WHERE vk * {size!r} >= {height!r})"""


def volume_sql(sigma: float) -> str:
    return smoothed_sql("v", "n", {"vi": "ni", "vj": "nj", "vk": "nk"}, sigma)


@query(f"{RP}, {VOX20}, {markers_sql('chm', 20.0, 0.5, 2, 3, 40.0)} SELECT plot, CAST(marker AS INT) AS marker, vi, vj, vk FROM markers")
def seed_markers(spark: SparkSession, d: str) -> DataFrame:
    p = Watershed(voxel_size=20.0, min_tree_height=40.0, min_crown_radius_m=40.0)
    return segment.seeds(_voxels(spark, d), "chm", p)


def forest_sql(size: float) -> str:
    """CTE ``pv`` (plot, point_id, lab) from ``markers`` and the smoothed volume t3, grown voxel by voxel from all markers at once: of all faces
    between what has a label and what has none the first is taken, which is the same forest as by rounds of parts."""
    item = "{'lo': -LEAST(a.d, z.d), 'hi': -GREATEST(a.d, z.d), 'u': LEAST(a.id, z.id), 'v': GREATEST(a.id, z.id), 'to': z.id}"
    labelled = "LIST_TRANSFORM({list}, lambda x: {{'lo': x.lo, 'hi': x.hi, 'u': x.u, 'v': x.v, 'to': x.to, 'lab': {lab}}})"
    return f"""vx AS MATERIALIZED (SELECT v.plot, v.vi, v.vj, v.vk, ROUND(t3.d, 9) AS d, ROW_NUMBER() OVER (PARTITION BY v.plot ORDER BY v.vi, v.vj, v.vk) AS id FROM v JOIN t3 ON t3.plot = v.plot AND t3.vi = v.vi AND t3.vj = v.vj AND t3.vk = v.vk),
nb AS MATERIALIZED (SELECT a.plot, a.id, LIST({item}) AS n FROM vx a JOIN (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) o(di, dj, dk) ON TRUE JOIN vx z ON z.plot = a.plot AND z.vi = a.vi + o.di AND z.vj = a.vj + o.dj AND z.vk = a.vk + o.dk GROUP BY a.plot, a.id),
mk AS MATERIALIZED (SELECT vx.plot, vx.id, CAST(marker AS BIGINT) AS lab FROM markers m JOIN vx ON vx.plot = m.plot AND vx.vi = m.vi AND vx.vj = m.vj AND vx.vk = m.vk),
fs AS (SELECT mk.plot, FLATTEN(LIST({labelled.format(list="COALESCE(nb.n, [])", lab="mk.lab")})) AS faces, LIST(mk.id) AS done, LIST(mk.lab) AS labs FROM mk LEFT JOIN nb ON nb.plot = mk.plot AND nb.id = mk.id GROUP BY mk.plot),
fl(plot, faces, done, labs) AS (SELECT plot, LIST_FILTER(faces, lambda x: NOT LIST_CONTAINS(done, x.to)), done, labs FROM fs UNION ALL
  SELECT f.plot, LIST_CONCAT(LIST_FILTER(faces, lambda x: x.to <> top.to), LIST_FILTER({labelled.format(list="COALESCE(nb.n, [])", lab="top.lab")}, lambda x: NOT LIST_CONTAINS(done, x.to))), LIST_APPEND(done, top.to), LIST_APPEND(labs, top.lab)
  FROM (SELECT *, LIST_MIN(faces) AS top FROM fl WHERE LEN(faces) > 0) f LEFT JOIN nb ON nb.plot = f.plot AND nb.id = f.top.to),
fd AS (SELECT plot, UNNEST(done) AS id, UNNEST(labs) AS lab FROM fl WHERE LEN(faces) = 0),
pv AS (SELECT p.plot, p.point_id, COALESCE(fd.lab, 0) AS lab FROM p JOIN o ON o.plot = p.plot JOIN vx ON vx.plot = p.plot AND vx.vi = FLOOR((x - x0) / {size!r}) AND vx.vj = FLOOR((y - y0) / {size!r}) AND vx.vk = FLOOR((z - z0) / {size!r}) LEFT JOIN fd ON fd.plot = vx.plot AND fd.id = vx.id)"""


def segmentation_sql(seeding: str, size: float = 20.0, sigma: float = 0.5, d: int = 2, band: int = 3, height: float = 40.0, least: int = 5) -> str:
    return f"""{RP}, {voxels_sql(size)}, {volume_sql(sigma)}, {markers_sql(seeding, size, sigma, d, band, height)}, {forest_sql(size)}
SELECT plot, point_id, CAST(CASE WHEN COUNT(*) OVER (PARTITION BY plot, lab) < {least} THEN 0 ELSE lab END AS INT) AS instance_id FROM pv"""


@query(segmentation_sql("chm"))
def segmentation_chm(spark: SparkSession, d: str) -> DataFrame:
    p = Watershed(voxel_size=20.0, min_tree_height=40.0, min_points_per_tree=5, gaussian_sigma=0.5, min_crown_radius_m=40.0)
    return segment.segment(points(spark, d), "chm", p, axes=("x", "y", "z")).select("plot", "point_id", "instance_id")


@query(segmentation_sql("density"))
def segmentation_density(spark: SparkSession, d: str) -> DataFrame:
    p = Watershed(voxel_size=20.0, min_tree_height=40.0, min_points_per_tree=5, gaussian_sigma=0.5, min_crown_radius_m=40.0, top_band_m=60.0)
    return segment.segment(points(spark, d), "density", p, axes=("x", "y", "z")).select("plot", "point_id", "instance_id")


FOUR = {"voxel_size": (20.0, 30.0), "gaussian_sigma": (0.5,), "min_crown_radius_m": (40.0, 80.0), "top_band_m": (60.0,)}


def _f1_sql(seeding: str, i: int, c: dict[str, float]) -> str:
    """F1 per plot of one combination, from whole segmentations of points."""
    size = c["voxel_size"]
    found = segmentation_sql(seeding, size, c["gaussian_sigma"], segment.half_width(c["min_crown_radius_m"], size), voxel.band_voxels(c["top_band_m"], size))
    return f"""SELECT {i} AS combo, plot, CASE WHEN g > 0 AND q > 0 THEN 2.0 * COALESCE(tp, 0) / (g + q) ELSE 0 END AS f1 FROM (
  WITH s AS MATERIALIZED ({found}), j AS MATERIALIZED (SELECT s.plot, s.instance_id AS pred_id, p.gt_id FROM s JOIN p ON p.plot = s.plot AND p.point_id = s.point_id),
  c AS (SELECT plot, pred_id, gt_id, COUNT(*) AS n FROM j GROUP BY ALL), a AS (SELECT plot, pred_id, SUM(n) AS n FROM c GROUP BY ALL), b AS (SELECT plot, gt_id, SUM(n) AS n FROM c GROUP BY ALL),
  r AS (SELECT c.plot, c.pred_id, c.gt_id, c.n / (a.n + b.n - c.n) AS iou FROM c JOIN a ON a.plot = c.plot AND a.pred_id = c.pred_id JOIN b ON b.plot = c.plot AND b.gt_id = c.gt_id WHERE c.pred_id > 0 AND c.gt_id > 0),
  h AS (SELECT plot, COUNT(*) AS tp FROM (SELECT plot, ROW_NUMBER() OVER (PARTITION BY plot, gt_id ORDER BY iou DESC, pred_id) AS x, ROW_NUMBER() OVER (PARTITION BY plot, pred_id ORDER BY iou DESC, gt_id) AS y FROM r WHERE iou >= 0.5) WHERE x = 1 AND y = 1 GROUP BY plot)
  SELECT j.plot, COUNT(DISTINCT CASE WHEN gt_id > 0 THEN gt_id END) AS g, COUNT(DISTINCT CASE WHEN pred_id > 0 THEN pred_id END) AS q, MAX(tp) AS tp FROM j LEFT JOIN h ON h.plot = j.plot GROUP BY j.plot)"""


def _four_sql() -> str:
    combos = gridsearch.combinations(FOUR)
    values = ", ".join(f"('{m}', {i}, {', '.join(repr(v) for v in c.values())})" for m in segment.SEEDINGS for i, c in enumerate(combos))
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, combo, f1 FROM ({_f1_sql(m, i, c)})" for m in segment.SEEDINGS for i, c in enumerate(combos))
    return f"""{P}, f AS MATERIALIZED ({rows}) SELECT v.method, {", ".join(FOUR)}, ROUND(AVG(f1), 6) AS mean_f1, ROUND(STDDEV_POP(f1), 6) AS std_f1, COUNT(f1) AS n_plots
FROM (VALUES {values}) v(method, combo, {", ".join(FOUR)}) JOIN f ON f.method = v.method AND f.combo = v.combo GROUP BY ALL"""


@query(_four_sql())
def grid_search_four(spark: SparkSession, d: str) -> DataFrame:
    """Four combinations of both seedings, a grid small enough for its SQL form."""
    base = Watershed(min_tree_height=40.0, min_points_per_tree=5)
    found = [gridsearch.summarise(gridsearch.score_plots(points(spark, d), m, FOUR, base, axes=("x", "y", "z")), FOUR).select(F.lit(m).alias("method"), *FOUR, r6("mean_f1"), r6("std_f1"), "n_plots") for m in segment.SEEDINGS]
    return found[0].unionByName(found[1])


# --- features --------------------------------------------------------------------------------------


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("plot", "point_id", (F.col("x") / 20).alias("x"), (F.col("y") / 5).alias("y"), (F.col("z") / 50).alias("z"))
    return p.withColumn("hag", F.col("z")).withColumn("intensity", F.col("z") / 20)


@query()
def geometric_features(spark: SparkSession, d: str) -> DataFrame:
    return features.extract(_scaled(spark, d))


def _shapes(k: int) -> str:
    """CTE f{k}: the features of neighbourhoods of k, by closed-form eigenvalues; no row below four neighbours."""
    cov = lambda a, b: f"COVAR_POP(b.{a}, b.{b})"
    return f"""m{k} AS (SELECT nb.plot, nb.point_id, {cov("x", "x")} AS xx, {cov("x", "y")} AS xy, {cov("x", "z")} AS xz, {cov("y", "y")} AS yy, {cov("y", "z")} AS yz, {cov("z", "z")} AS zz, MAX(b.z) - MIN(b.z) AS height_range
  FROM nb JOIN c b ON b.plot = nb.plot AND b.point_id = nb.other WHERE r <= {k} GROUP BY ALL HAVING COUNT(*) >= 4),
q{k} AS (SELECT *, (xx + yy + zz) / 3 AS q, SQRT(GREATEST(0, ((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6)) AS pp FROM m{k}),
a{k} AS (SELECT *, ACOS(GREATEST(-1, LEAST(1, COALESCE(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / NULLIF(2 * pp * pp * pp, 0), 1)))) / 3 AS phi FROM q{k}),
l{k} AS (SELECT *, GREATEST(1e-10, q + 2 * pp * COS(phi)) AS l1, GREATEST(1e-10, q + 2 * pp * COS(phi + 2 * PI() / 3)) AS l3, GREATEST(1e-10, 3 * q - (q + 2 * pp * COS(phi)) - (q + 2 * pp * COS(phi + 2 * PI() / 3))) AS l2 FROM a{k}),
f{k} AS (SELECT plot, point_id, (l1 - l2) / l1 AS linearity, (l2 - l3) / l1 AS planarity, l3 / l1 AS sphericity, CBRT(l1 * l2 * l3) / (l1 + l2 + l3) AS omnivariance, (l1 - l3) / l1 AS anisotropy,
  -(l1 / (l1 + l2 + l3) * LN(l1 / (l1 + l2 + l3) + 1e-10) + l2 / (l1 + l2 + l3) * LN(l2 / (l1 + l2 + l3) + 1e-10) + l3 / (l1 + l2 + l3) * LN(l3 / (l1 + l2 + l3) + 1e-10)) AS eigenentropy,
  l1 + l2 + l3 AS sum_eigenvalues, l3 / (l1 + l2 + l3) AS change_curvature, SQRT(zz) AS roughness, height_range FROM l{k})"""


SHAPES = ("linearity", "planarity", "sphericity", "omnivariance", "anisotropy", "eigenentropy", "sum_eigenvalues", "change_curvature", "roughness", "height_range")


@query(
    f"""{P}, c AS MATERIALIZED (SELECT plot, point_id, x / 20 AS x, y / 5 AS y, z / 50 AS z FROM p),
d AS MATERIALIZED (SELECT a.plot, a.point_id, b.point_id AS other, SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM c a JOIN c b ON a.plot = b.plot AND ABS(a.x - b.x) <= 5 AND ABS(a.y - b.y) <= 5 AND ABS(a.z - b.z) <= 5),
n AS (SELECT plot, point_id, COUNT(*) AS density FROM d WHERE d <= 0.5 GROUP BY ALL),
nb AS MATERIALIZED (SELECT plot, point_id, other, ROW_NUMBER() OVER (PARTITION BY plot, point_id ORDER BY d, other) AS r FROM d WHERE d <= 5 AND point_id <> other QUALIFY r <= 50), {_shapes(20)}, {_shapes(50)}
SELECT c.plot, COUNT(*) AS n, ROUND(AVG(density), 3) AS density, {", ".join(f"ROUND(AVG(COALESCE(f{k}.{s}, 0)), 3) AS {s}_k{k}" for k in (20, 50) for s in SHAPES)}, ROUND(AVG(CASE WHEN f20.plot IS NULL THEN 0 ELSE z END), 3) AS "HAG_k20", ROUND(AVG(CASE WHEN f50.plot IS NULL THEN 0 ELSE z / 20 END), 3) AS intensity_k50
FROM c JOIN n ON n.plot = c.plot AND n.point_id = c.point_id LEFT JOIN f20 ON f20.plot = c.plot AND f20.point_id = c.point_id LEFT JOIN f50 ON f50.plot = c.plot AND f50.point_id = c.point_id GROUP BY c.plot"""
)
def feature_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the extracted features; the verticality has no closed form where eigenvalues tie, and is left to the tests."""
    names = ["density", *[f"{s}_k{k}" for k in (20, 50) for s in SHAPES], "HAG_k20", "intensity_k50"]
    return features.extract(_scaled(spark, d)).groupBy("plot").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 3).alias(c) for c in names])


# --- samples ---------------------------------------------------------------------------------------


@query(
    f"""{P}, r AS (SELECT plot, point_id, ROW_NUMBER() OVER (PARTITION BY plot ORDER BY {draw_sql(42, "plot", "point_id")}, point_id) - 1 AS r, COUNT(*) OVER (PARTITION BY plot) AS n FROM p), s AS (SELECT UNNEST(RANGE(300)) AS position)
SELECT plot, point_id, position FROM s JOIN r ON r.r = position % LEAST(n, 300)"""
)
def sampled_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sampling.block(points(spark, d), 300).select("plot", "point_id", "position")


PASSES = f"pb AS MATERIALIZED (SELECT plot, pass, point_id FROM p, (SELECT UNNEST(RANGE(6)) AS pass) t QUALIFY ROW_NUMBER() OVER (PARTITION BY plot, pass ORDER BY {draw_sql(42, 'pass', 'plot', 'point_id')}, point_id) <= 64)"


@query(f"{P}, {PASSES} SELECT plot, CAST(pass AS INT) AS pass, point_id FROM pb")
def pass_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pass_blocks(points(spark, d).select("plot", "point_id"), 6, 64).select("plot", "pass", "point_id")


@query(f"{P}, {PASSES}, c AS (SELECT p.plot, p.point_id, COUNT(pass) AS n FROM p LEFT JOIN pb ON pb.plot = p.plot AND pb.point_id = p.point_id GROUP BY ALL) SELECT plot, COUNT(*) AS total, COUNT(CASE WHEN n > 0 THEN 1 END) AS covered, COUNT(CASE WHEN n = 0 THEN 1 END) AS uncovered, ROUND(100 * COUNT(CASE WHEN n > 0 THEN 1 END) / COUNT(*), 6) AS covered_pct FROM c GROUP BY plot")
def coverage_simulation(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("plot", "point_id")
    n = sampling.pass_blocks(p, 6, 64).groupBy("plot", "point_id").agg(F.count("*").alias("n_samples"))
    return rounded(semantic.coverage(labels.scatter(p, n, {"n_samples": 0}), ["plot"]), "covered_pct")


SCALE, FLIP = f"(0.9 + {draw_sql(42, chr(39) + 'scale' + chr(39), 'plot')} * 0.2)", f"(CASE WHEN {draw_sql(42, chr(39) + 'flip' + chr(39), 'plot')} < 0.5 THEN -1 ELSE 1 END)"


def _noise(axis: str) -> str:
    u, v = (draw_sql(42, f"'{axis}'", "plot", "point_id", i) for i in (1, 2))
    return f"SQRT(-2 * LN(1 - {u})) * COS(2 * PI() * {v})"


@query(f"{P} SELECT plot, point_id, ROUND((x + 0.02 * {_noise('x')}) * {SCALE} * {FLIP}, 5) + 0.0 AS x, ROUND((y + 0.02 * {_noise('y')}) * {SCALE}, 5) + 0.0 AS y, ROUND((z + 0.02 * {_noise('z')}) * {SCALE}, 5) + 0.0 AS z FROM p")
def augmented_points(spark: SparkSession, d: str) -> DataFrame:
    return sampling.augment(points(spark, d)).select("plot", "point_id", *[(F.round(a, 5) + 0.0).alias(a) for a in ("x", "y", "z")])


@query(f"SELECT n_nationkey AS i, b, CAST({index_sql(42, 'b', 'n_nationkey', '25')} AS INT) AS taken FROM nation, (SELECT UNNEST(RANGE(40)) AS b) t")
def bootstrap_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("b"))
    return rows.select("i", "b", sampling.bootstrap_index(F.col("b"), F.col("i"), F.lit(25)).alias("taken"))


FARTHEST = f"""{RP}, bk AS MATERIALIZED (SELECT plot, point_id, x, y FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY plot ORDER BY {draw_sql(42, "plot", "point_id")}, point_id) <= 200),
bi AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY plot ORDER BY point_id) - 1 AS i, COUNT(*) OVER (PARTITION BY plot) AS n FROM bk),
fp(plot, rank, px, py, ids) AS (SELECT plot, CAST(0 AS INT), [x], [y], [point_id] FROM bi WHERE i = FLOOR({draw_sql(42, "plot")} * n) UNION ALL
  SELECT plot, rank + 1, LIST_APPEND(px, m.x), LIST_APPEND(py, m.y), LIST_APPEND(ids, m.point_id) FROM (
    SELECT fp.plot, fp.rank, fp.px, fp.py, fp.ids, ARG_MAX({{'x': b.x, 'y': b.y, 'point_id': b.point_id}}, {{'d': LIST_MIN(LIST_TRANSFORM(LIST_ZIP(px, py), lambda q: (q[1] - b.x) * (q[1] - b.x) + (q[2] - b.y) * (q[2] - b.y))), 'o': -b.point_id}}) AS m
    FROM fp JOIN bi b ON b.plot = fp.plot WHERE fp.rank < 7 GROUP BY fp.plot, fp.rank, fp.px, fp.py, fp.ids)),
fs AS MATERIALIZED (SELECT plot, ids FROM fp WHERE rank = 7)"""


@query(f"""{FARTHEST.replace("QUALIFY ROW_NUMBER() OVER (PARTITION BY plot ORDER BY " + draw_sql(42, "plot", "point_id") + ", point_id) <= 200", "").replace("rank < 7", "rank < 15").replace("rank = 7", "rank = 15")}
SELECT plot, CAST(i - 1 AS INT) AS "rank", ids[i] AS point_id FROM (SELECT plot, ids, UNNEST(RANGE(1, 17)) AS i FROM fs)""")
def farthest_of_plots(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen farthest points of every whole plot, bucket by bucket."""
    return farthest.farthest_points(points(spark, d), 16, ("x", "y"))


def _block(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cap_per_class(points(spark, d), 200, ("plot",))


@query(f'{FARTHEST} SELECT plot, CAST(i - 1 AS INT) AS "rank", ids[i] AS point_id FROM (SELECT plot, ids, UNNEST(RANGE(1, 9)) AS i FROM fs)')
def farthest_samples(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.farthest_points(_block(spark, d), 8, ("x", "y"))


@query(f"""{FARTHEST}, ct AS (SELECT plot, UNNEST(ids) AS point_id FROM fs), q AS (SELECT c.plot, c.point_id, o.point_id AS other, ROW_NUMBER() OVER (PARTITION BY c.plot, c.point_id ORDER BY o.point_id) AS r FROM ct c JOIN bk a ON a.plot = c.plot AND a.point_id = c.point_id JOIN bk o ON o.plot = c.plot AND (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) <= 144),
g AS (SELECT plot, point_id, LIST(other ORDER BY other) AS m FROM q WHERE r <= 5 GROUP BY ALL)
SELECT plot, point_id, ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(5), lambda i: COALESCE(m[i + 1], m[1])), ',') AS members FROM g""")
def grouped_samples(spark: SparkSession, d: str) -> DataFrame:
    got = neighbors.sample_and_group(_block(spark, d), 8, 12.0, 5, ("x", "y"))
    return got.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


# --- blocks and networks -----------------------------------------------------------------------------


@query(
    f"""{P}, b AS MATERIALIZED (SELECT plot, point_id, x, y, z FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY plot ORDER BY {draw_sql(42, "plot", "point_id")}, point_id) <= 128),
c AS (SELECT plot, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM b GROUP BY plot), q AS (SELECT b.plot, point_id, x - mx AS x, y - my AS y, z - mz AS z, z / 10 AS hag FROM b JOIN c ON b.plot = c.plot), f AS (SELECT plot, MAX(SQRT(x * x + y * y + z * z)) AS far FROM q GROUP BY plot)
SELECT q.plot, point_id, ROUND(x / (far + 1e-8), 6) + 0.0 AS x, ROUND(y / (far + 1e-8), 6) + 0.0 AS y, ROUND(z / (far + 1e-8), 6) + 0.0 AS z, ROUND(LEAST(1, hag / 50), 6) AS hag FROM q JOIN f ON q.plot = f.plot"""
)
def block_dataset(spark: SparkSession, d: str) -> DataFrame:
    """One training block per plot: sampled, about its centre in the unit sphere, heights over 50."""
    b = sampling.block(points(spark, d), 128).withColumn("hag", clamp(F.col("z") / 10 / 50, 0.0, 1.0))
    got = sampling.block_normalised(b)
    return got.select("plot", "point_id", *[(F.round(a, 6) + 0.0).alias(a) for a in ("x", "y", "z")], r6("hag"))


def _by_height(x):  # noqa: ANN001, ANN202
    """A scorer in the network's place: the height channel is the probability of a tree."""
    import numpy as np

    return np.stack([1 - x[:, :, 3], x[:, :, 3]], 2)


@query(
    f"""{P}, {PASSES}, h AS MATERIALIZED (SELECT plot, point_id, x, y, z, CAST(CAST(LEAST(1, GREATEST(0, z / 10 / 50)) AS FLOAT) AS DOUBLE) AS v, EXISTS (SELECT 1 FROM pb WHERE pb.plot = p.plot AND pb.point_id = p.point_id) AS seen FROM p),
q AS (SELECT u.plot, u.point_id, c.v, (u.x - c.x) ** 2 + (u.y - c.y) ** 2 + (u.z - c.z) ** 2 AS d2 FROM h u JOIN h c ON u.plot = c.plot AND c.seen AND NOT u.seen QUALIFY ROW_NUMBER() OVER (PARTITION BY u.plot, u.point_id ORDER BY d2, c.point_id) <= 3),
w AS (SELECT plot, point_id, v, CASE WHEN d2 = 0 THEN 1.0 ELSE 1 / (SQRT(d2) + 1e-8) END AS w FROM q), a AS (SELECT plot, point_id, v FROM h WHERE seen UNION ALL SELECT plot, point_id, SUM(w * v) / SUM(w) FROM w GROUP BY ALL)
SELECT plot, point_id, ROUND(v, 5) AS p1, CAST(CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS INT) AS semantic_pred FROM a"""
)
def block_inference(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities over six passes of sampled blocks; points in none of them take those of their neighbours."""
    p = points(spark, d).select("plot", "point_id", "x", "y", "z", (F.col("z") / 10).alias("hag"), F.lit(0.5).alias("intensity"), labels.binary_label().alias("label"))
    whole, _ = ml.block_inference(p, _by_height, 6, 80.0, Blocks(points=64))
    return whole.select("plot", "point_id", F.round("p1", 5).alias("p1"), F.col("semantic_pred").cast("int").alias("semantic_pred"))


W1, B1 = [[0.5, -0.25, 0.01], [-1.0, 0.5, 0.0], [0.1, 0.1, -0.02]], [0.5, 0.0, 1.0]
W2, B2 = [[0.2, 0.3, -0.01]], [0.25]
W3, B3 = [[0.5, 0.25, -0.5, 1.0, 0.01], [-0.1, 0.2, 0.3, 0.4, -0.02]], [0.0, 0.5]


def _layer_sql(inputs: list[str], weights: list[list[float]], bias: list[float]) -> list[str]:
    return [f"GREATEST(0, {b!r} + " + " + ".join(f"{x} * {w!r}" for x, w in zip(inputs, row, strict=True)) + ")" for row, b in zip(weights, bias, strict=True)]


OFFSETS = ["(o.x - a.x)", "(o.y - a.y)", "o.z"]


def _ball_sql(name: str, radius: float, n: int, weights: list[list[float]], bias: list[float]) -> str:
    return f"""{name}q AS (SELECT c.plot, c.point_id, a.x AS ax, a.y AS ay, o.point_id AS other FROM ct c JOIN zk a ON a.plot = c.plot AND a.point_id = c.point_id JOIN zk o ON o.plot = c.plot AND (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) <= {radius * radius!r} QUALIFY ROW_NUMBER() OVER (PARTITION BY c.plot, c.point_id ORDER BY o.point_id) <= {n}),
{name} AS (SELECT q.plot, q.point_id, {", ".join(f"MAX({x}) AS {name}{i}" for i, x in enumerate(_layer_sql(OFFSETS, weights, bias)))} FROM {name}q q JOIN zk a ON a.plot = q.plot AND a.point_id = q.point_id JOIN zk o ON o.plot = q.plot AND o.point_id = q.other GROUP BY ALL)"""


ABSTRACT = f"""{FARTHEST}, ct AS (SELECT plot, UNNEST(ids) AS point_id FROM fs), zk AS MATERIALIZED (SELECT bk.plot, bk.point_id, bk.x, bk.y, p.z FROM bk JOIN p ON p.plot = bk.plot AND p.point_id = bk.point_id),
{_ball_sql("sa", 12.0, 5, W1, B1)}, {_ball_sql("sb", 30.0, 9, W2, B2)},
ab AS MATERIALIZED (SELECT sa.plot, sa.point_id, sa0, sa1, sa2, sb0 FROM sa JOIN sb ON sb.plot = sa.plot AND sb.point_id = sa.point_id)"""


def _abstracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = _block(spark, d)
    return b, ml.set_abstraction(b, [(12.0, 5, W1, B1), (30.0, 9, W2, B2)], 8, ("z",), ("x", "y"))


@query(f"{ABSTRACT} SELECT plot, point_id, ROUND(sa0, 6) AS c0, ROUND(sa1, 6) AS c1, ROUND(sa2, 6) AS c2, ROUND(sb0, 6) AS c3 FROM ab")
def set_abstraction(spark: SparkSession, d: str) -> DataFrame:
    _, found = _abstracted(spark, d)
    return found.select("plot", "point_id", *[r6(F.col("channels")[i], f"c{i}") for i in range(4)])


@query(
    f"""{ABSTRACT}, nq AS (SELECT u.plot, u.point_id, sa0, sa1, sa2, sb0, (u.x - c.x) ** 2 + (u.y - c.y) ** 2 AS d2 FROM zk u JOIN ab ON ab.plot = u.plot JOIN zk c ON c.plot = ab.plot AND c.point_id = ab.point_id QUALIFY ROW_NUMBER() OVER (PARTITION BY u.plot, u.point_id ORDER BY d2, c.point_id) <= 3),
nw AS (SELECT *, 1 / (d2 + 1e-8) AS w FROM nq), na AS (SELECT plot, point_id, SUM(w * sa0) / SUM(w) AS a0, SUM(w * sa1) / SUM(w) AS a1, SUM(w * sa2) / SUM(w) AS a2, SUM(w * sb0) / SUM(w) AS a3 FROM nw GROUP BY ALL)
SELECT na.plot, na.point_id, {", ".join(f"ROUND({x}, 5) AS c{i}" for i, x in enumerate(_layer_sql(["a0", "a1", "a2", "a3", "zk.z"], W3, B3)))} FROM na JOIN zk ON zk.plot = na.plot AND zk.point_id = na.point_id"""
)
def feature_propagation(spark: SparkSession, d: str) -> DataFrame:
    b, found = _abstracted(spark, d)
    centres = found.join(b.select("plot", "point_id", "x", "y"), ["plot", "point_id"])
    got = ml.propagate(b, centres, W3, B3, 80.0, ("z",), ("x", "y"))
    return got.select("plot", "point_id", *[F.round(F.col("channels")[i], 5).alias(f"c{i}") for i in range(2)])


@query(
    f"""{TERRAIN}, t AS (SELECT plot, MAX(z) AS top FROM p GROUP BY plot)
SELECT p.plot, p.point_id, CAST({LABEL.replace("classification", "p.classification")} AS INT) AS label, ROUND(CAST(CAST(CASE WHEN top > 0 THEN p.z / top ELSE p.z END AS FLOAT) AS DOUBLE), 6) AS intensity, ROUND(CAST(CAST(hag AS FLOAT) AS DOUBLE), 6) AS hag FROM p JOIN t ON t.plot = p.plot JOIN hag h ON h.plot = p.plot AND h.point_id = p.point_id"""
)
def prepared_points(spark: SparkSession, d: str) -> DataFrame:
    """The first step of every flow: scaled intensities, labels and heights."""
    cfg = Config(terrain=Terrain(resolution=50.0, hag_max=500.0))
    got = flows.prepare(points(spark, d).withColumn("intensity", F.col("z")), cfg)
    return got.select("plot", "point_id", "label", r6(F.col("intensity").cast("double"), "intensity"), r6(F.col("hag").cast("double"), "hag"))


@query(
    f"""{P}, v AS MATERIALIZED (SELECT plot, gt_id, pred_id, {LABEL} AS label, pred_id % 2 AS s FROM p WHERE {LABEL} <> -1),
c AS (SELECT plot, pred_id, gt_id, COUNT(*) AS i FROM v GROUP BY ALL), np AS (SELECT plot, pred_id, SUM(i) AS n FROM c WHERE pred_id > 0 GROUP BY ALL), ng AS (SELECT plot, gt_id, SUM(i) AS n FROM c WHERE gt_id > 0 GROUP BY ALL),
x AS (SELECT c.plot, c.pred_id, c.gt_id, i / (np.n + ng.n - i) AS iou FROM c JOIN np ON np.plot = c.plot AND np.pred_id = c.pred_id JOIN ng ON ng.plot = c.plot AND ng.gt_id = c.gt_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY plot, gt_id ORDER BY iou DESC, pred_id) AS a, ROW_NUMBER() OVER (PARTITION BY plot, pred_id ORDER BY iou DESC, gt_id) AS b FROM x WHERE iou >= 0.5), h AS (SELECT plot, COUNT(*) AS tp FROM r WHERE a = 1 AND b = 1 GROUP BY plot),
s AS (SELECT v.plot, COUNT(DISTINCT CASE WHEN gt_id > 0 THEN gt_id END) AS g, COUNT(DISTINCT CASE WHEN pred_id > 0 THEN pred_id END) AS q, AVG(CASE WHEN label = s THEN 1.0 ELSE 0.0 END) AS acc, COUNT(*) AS n FROM v GROUP BY v.plot)
SELECT s.plot, 'site' AS institution, COALESCE(tp, 0) AS "TP", q - COALESCE(tp, 0) AS "FP", g - COALESCE(tp, 0) AS "FN", ROUND(2 * COALESCE(tp, 0) / (q + g), 6) AS f1, ROUND(acc, 6) AS sem_accuracy, n AS sem_n_points_evaluated FROM s LEFT JOIN h ON h.plot = s.plot"""
)
def flow_scores(spark: SparkSession, d: str) -> DataFrame:
    """The last step of a flow: stored instances and predictions scored on the valid points."""
    p = points(spark, d).withColumn("label", labels.binary_label()).withColumn("institution", F.lit("site")).withColumn("tree_id", F.col("gt_id"))
    found = p.select(F.lit("rf").alias("method"), "plot", "point_id", (F.col("pred_id") % 2).cast("int").alias("semantic_pred"), F.col("pred_id").cast("int").alias("instance_id"))
    return rounded(flows.score(p, found), "f1", "sem_accuracy").select("plot", "institution", "TP", "FP", "FN", "f1", "sem_accuracy", "sem_n_points_evaluated")


# --- intervals and the normal distribution -----------------------------------------------------------

NAMED = dict(zip(METHODS, PRIORITIES, strict=True))
PAIRED = tuple((NAMED[a], NAMED[b]) for a, b in COMPARISONS)
SCORED = ("f1", "precision", "recall", "coverage")


def cdf_sql(z: str) -> str:
    """The normal distribution function by its power series in z; DuckDB has none of its own."""
    z = f"GREATEST(-6.0, LEAST(6.0, {z}))"
    return f"(0.5 + EXP(-{z} * {z} / 2) / SQRT(2 * PI()) * LIST_SUM(LIST_TRANSFORM(RANGE(120), lambda k: {z} ** (2 * k + 1) / EXP((k + 1) * LN(2) + LGAMMA(k + 1.5) - LN(PI()) / 2))))"


def ppf_ctes(source: str, key: str, p: str) -> str:
    """CTE ``quantile`` (key, z): Newton's steps from 0 on the distribution function, which never overshoot."""
    return f"""newton(id, target, step, z) AS (SELECT {key}, {p}, 0, CAST(0 AS DOUBLE) FROM {source} UNION ALL
  SELECT id, target, step + 1, z - ({cdf_sql("z")} - target) / (EXP(-z * z / 2) / SQRT(2 * PI())) FROM newton WHERE step < 40),
quantile AS MATERIALIZED (SELECT id, z FROM newton WHERE step = 40)"""


@query(f"WITH RECURSIVE src AS MATERIALIZED (SELECT p_size, (p_size * 19 - 9) / 1000.0 AS share FROM (SELECT DISTINCT p_size FROM part)), {ppf_ctes('src', 'p_size', 'share')} SELECT p_size, ROUND({cdf_sql('((p_size - 25) / 8.0)')}, 6) AS cdf, ROUND(z, 6) + 0.0 AS ppf FROM src JOIN quantile ON id = p_size")
def normal_values(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select("p_size").distinct()
    got = sizes.select("p_size", normal_cdf((F.col("p_size") - 25) / 8.0).alias("cdf"), normal_ppf((F.col("p_size") * 19 - 9) / 1000.0).alias("ppf"))
    return got.select("p_size", r6("cdf"), (F.round("ppf", 6) + 0.0).alias("ppf"))


def _plan() -> str:
    rows = [("method", m, v) for m in PRIORITIES for v in SCORED] + [("difference", f"{a} -> {b}", "f1") for a, b in PAIRED]
    return "(VALUES " + ", ".join(f"('{t}', '{n}', '{v}', {42 + i})" for i, (t, n, v) in enumerate(rows)) + ") pl(type, label, metric, seed)"


TAIL = stats.NORMAL.inv_cdf(0.025)


@query(
    f"""{RM}, u AS (SELECT plot, method, metric, value FROM (SELECT plot, method, {", ".join(f'"{v}"' for v in SCORED)} FROM m) UNPIVOT (value FOR metric IN ({", ".join(f'"{v}"' for v in SCORED)}))),
pr AS (SELECT UNNEST({[a for a, _ in PAIRED]}) AS a, UNNEST({[b for _, b in PAIRED]}) AS b),
al AS (SELECT 'method' AS type, method AS label, metric, plot, value FROM u UNION ALL SELECT 'difference', pr.a || ' -> ' || pr.b, 'f1', x.plot, y.value - x.value FROM pr JOIN u x ON x.method = pr.a AND x.metric = 'f1' JOIN u y ON y.method = pr.b AND y.metric = 'f1' AND y.plot = x.plot),
st AS MATERIALIZED (SELECT pl.type, pl.label, pl.metric, seed, LIST(value ORDER BY plot) AS v, COUNT(*) AS n, AVG(value) AS observed, SUM(CAST(ROUND(value * 1e9) AS BIGINT)) AS whole FROM al JOIN {_plan()} ON pl.type = al.type AND pl.label = al.label AND pl.metric = al.metric GROUP BY ALL),
bt AS MATERIALIZED (SELECT seed, b, SUM(CAST(ROUND(v[1 + {index_sql("seed", "b", "i", "n")}] * 1e9) AS BIGINT)) AS drawn FROM st, (SELECT UNNEST(RANGE(10000)) AS b) t, LATERAL (SELECT UNNEST(RANGE(n)) AS i) w GROUP BY seed, b),
bs AS MATERIALIZED (SELECT bt.seed, LIST(CAST(drawn AS DOUBLE) / n / 1e9 ORDER BY drawn) AS boot, GREATEST(1e-6, LEAST(1 - 1e-6, AVG(CASE WHEN drawn < whole THEN 1.0 ELSE 0.0 END))) AS below FROM bt JOIN st ON st.seed = bt.seed GROUP BY bt.seed),
{ppf_ctes("bs", "seed", "below")},
jk AS (SELECT seed, LIST_SUM(LIST_TRANSFORM(v, lambda x: ((x - observed) / (n - 1)) ** 3)) / (6 * LIST_SUM(LIST_TRANSFORM(v, lambda x: ((x - observed) / (n - 1)) ** 2)) ** 1.5) AS acc FROM st),
pc AS (SELECT bs.seed, boot, {cdf_sql(f"(z + (z + {TAIL!r}) / (1 - acc * (z + {TAIL!r})))")} * 9999 AS lo, {cdf_sql(f"(z + (z - {TAIL!r}) / (1 - acc * (z - {TAIL!r})))")} * 9999 AS hi FROM bs JOIN quantile ON id = bs.seed JOIN jk ON jk.seed = bs.seed),
plc AS (SELECT *, CAST(FLOOR(lo) AS BIGINT) AS l, CAST(FLOOR(hi) AS BIGINT) AS h FROM pc)
SELECT type, label, metric, st.seed, ROUND(observed, 6) + 0.0 AS observed, ROUND(boot[l + 1] + (boot[LEAST(l + 2, 10000)] - boot[l + 1]) * (lo - l), 5) + 0.0 AS ci_lower, ROUND(boot[h + 1] + (boot[LEAST(h + 2, 10000)] - boot[h + 1]) * (hi - h), 5) + 0.0 AS ci_upper,
  n, CAST(10000 AS BIGINT) AS n_boot, 0.95e0 AS ci_level FROM st JOIN plc ON plc.seed = st.seed"""
)
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    got = stats.interval_table(metrics(spark, d), SCORED, PRIORITIES, PAIRED)
    return got.withColumns({"observed": F.round("observed", 6) + 0.0, "ci_lower": F.round("ci_lower", 5) + 0.0, "ci_upper": F.round("ci_upper", 5) + 0.0})


@query(
    f"""{M}, v AS (SELECT plot, method, f1 AS p, recall - 0.33 AS diff FROM m), w AS (SELECT *, CASE WHEN diff > 0 THEN 'second is higher' WHEN diff < 0 THEN 'first is higher' ELSE 'no difference' END AS way FROM v)
SELECT plot, method, CASE WHEN p / 4 < 0.01 THEN '***' WHEN p / 4 < 0.05 THEN '**' WHEN p / 4 < 0.1 THEN '*' ELSE '' END AS stars, CASE WHEN p / 4 < 0.05 THEN 'significant: ' WHEN p / 4 < 0.1 THEN 'marginal: ' ELSE 'not significant: ' END || way AS verdict,
  (diff - 0.02 > 0 OR diff + 0.02 < 0) AS excludes_zero, ROUND(diff / NULLIF(p, 0), 6) + 0.0 AS effect FROM w"""
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = metrics(spark, d).select("plot", "method", (F.col("f1") / 4).alias("p"), (F.col("recall") - 0.33).alias("diff"), "f1")
    return v.select("plot", "method", report.stars(F.col("p")).alias("stars"), report.verdict(F.col("p"), F.col("diff")).alias("verdict"), stats.excludes_zero(F.col("diff") - 0.02, F.col("diff") + 0.02).alias("excludes_zero"), (F.round(stats.effect("diff", "f1"), 6) + 0.0).alias("effect"))


# --- small functions ---------------------------------------------------------------------------------


@query(f"{P} SELECT plot, point_id FROM p WHERE pred_id % 2 = 1 AND z / 10 >= 0.5 AND {LABEL} <> -1")
def valid_tree_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("plot", "point_id", (F.col("z") / 10).alias("hag"), labels.binary_label().alias("label"), (F.col("pred_id") % 2).alias("semantic_pred"))
    return labels.tree_points(p).select("plot", "point_id")


@query(f"{P} SELECT plot, point_id, ROUND(GREATEST(0, LEAST(50, z - 20)), 6) AS z FROM p")
def clamped_values(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("plot", "point_id", r6(clamp(F.col("z") - 20, 0.0, 50.0), "z"))


@query(f"{P}, h AS (SELECT plot, x, y, GREATEST(0, LEAST(50, z / 10)) AS hag FROM p), o AS (SELECT plot, MIN(x) AS x0, MIN(y) AS y0, MIN(hag) AS h0 FROM h GROUP BY plot) SELECT h.plot, CAST(FLOOR((x - x0) / 10.0) AS INT) AS vi, CAST(FLOOR((y - y0) / 10.0) AS INT) AS vj, CAST(FLOOR((hag - h0) / 10.0) AS INT) AS vk, COUNT(*) AS n FROM h JOIN o ON h.plot = o.plot GROUP BY ALL")
def height_voxels(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("hag", clamp(F.col("z") / 10, 0.0, 50.0))
    return voxel.counts(voxel.voxelise(p, 10.0, axes=("x", "y", "hag")))


@query(f"{P}, b AS (SELECT plot, (MIN(y) + MAX(y)) / 2 AS mid FROM p GROUP BY plot) SELECT p.plot, COUNT(*) AS n FROM p JOIN b ON p.plot = b.plot WHERE ABS(y - mid) < 5 GROUP BY p.plot")
def strict_slab(spark: SparkSession, d: str) -> DataFrame:
    return labels.slab(points(spark, d), 5.0, strict=True).groupBy("plot").agg(F.count("*").alias("n"))


@query(f"{M} SELECT plot, institution, method, ROUND(f1, 6) AS f1 FROM m WHERE method = '2-HIGH' ORDER BY plot LIMIT 1")
def first_row(spark: SparkSession, d: str) -> DataFrame:
    return labels.first_row(metrics(spark, d).select("plot", "institution", "method", r6("f1")), "method", "2-HIGH", "plot")


@query(f"{M} SELECT plot, method, ROUND(recall, 6) AS recall FROM m")
def column_subset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.subset(metrics(spark, d), ["plot", "missing", "method", "recall", "absent"]), "recall")


@query("SELECT event_id, REPLACE(event_type || '_' || CAST(user_id AS VARCHAR), '_', ' ') AS label FROM events")
def plot_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", labels.pretty(F.concat("event_type", F.lit("_"), F.col("user_id"), F.lit(": "), F.col("event_id"))).alias("label"))


@query(f"{P}, g AS (SELECT plot, gt_id AS id, LIST(point_id) AS a FROM p GROUP BY ALL), h AS (SELECT plot, pred_id AS id, LIST(point_id) AS b FROM p GROUP BY ALL) SELECT g.plot, g.id, ROUND(COALESCE(LEN(LIST_INTERSECT(a, b)) / NULLIF(LEN(LIST_DISTINCT(LIST_CONCAT(a, b))), 0), 0), 6) AS iou FROM g JOIN h ON g.plot = h.plot AND g.id = h.id")
def set_overlaps(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    sets = lambda c, name: p.groupBy("plot", F.col(c).alias("id")).agg(F.collect_set("point_id").alias(name))
    return sets("gt_id", "a").join(sets("pred_id", "b"), ["plot", "id"]).select("plot", "id", r6(matching.array_iou("a", "b"), "iou"))


@query(f"{P} SELECT plot AS institution, ROUND(SUM(n) / 30000.0, 6) AS density, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT plot, gt_id, COUNT(*) AS n FROM p GROUP BY ALL) GROUP BY plot")
def rough_density(spark: SparkSession, d: str) -> DataFrame:
    per = points(spark, d).groupBy(F.col("plot").alias("institution"), "gt_id").agg(F.count("*").alias("n"))
    return rounded(report.rough_density(per, "n"), "density")


@query("SELECT 'size ' || CAST(p_size AS VARCHAR) AS feature, ROUND(AVG(p_retailprice), 6) AS importance FROM part GROUP BY p_size ORDER BY AVG(p_retailprice) DESC, feature LIMIT 10")
def top_importances(spark: SparkSession, d: str) -> DataFrame:
    """The ten greatest of a model's importances; the sizes of parts stand for its features."""
    rows = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("v")).collect()
    return rounded(report.importances([r.v for r in rows], [f"size {r.p_size}" for r in rows], spark).limit(10), "importance")


@query("WITH l AS (SELECT CAST(event_id AS INT) AS epoch, CAST(event_id % 89 AS DOUBLE) / 100 AS miou FROM events WHERE event_id % 2 = 0) SELECT epoch, ROUND(miou, 6) AS miou FROM l ORDER BY miou DESC, epoch LIMIT 1")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    from stemline.plans.queries import training_log

    return report.first_best(training_log(spark, d), "miou", ["epoch"]).select("epoch", "miou")


@query(f"""{M}, w AS (SELECT o.i, o.method, AVG(f1) AS a, AVG(recall) AS b FROM (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(PRIORITIES))}) o(i, method) LEFT JOIN m ON m.method = o.method GROUP BY ALL)
SELECT '\\begin{{tabular}}{{lrr}}' || CHR(10) || '\\hline' || CHR(10) || 'method & f1 & recall \\\\' || CHR(10) || '\\hline' || CHR(10) || STRING_AGG(method || ' & ' || PRINTF('%.3f', a) || ' & ' || PRINTF('%.3f', b) || ' \\\\', CHR(10) ORDER BY i) || CHR(10) || '\\hline' || CHR(10) || '\\end{{tabular}}' || CHR(10) AS latex FROM w""")
def latex_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(report.latex(metrics(spark, d), ["f1", "recall"], methods=PRIORITIES),)], "latex string")
