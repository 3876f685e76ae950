"""Registered queries of sources and sinks: tables go out through a sink and come back through its source.

Each run has a folder of its own in the shared one that the session names.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline import config
from stemline.config import Features
from stemline.plans.projections import metrics, points, table
from stemline.plans.registry import M, P, query, r6, rounded
from stemline.sources import archives, features, las, shared, tables


def folder(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/stored-{uuid.uuid4().hex}"


def _files(rows: DataFrame, root: str, name: str, encode: Callable[[pd.DataFrame], bytes]) -> None:
    """Write one file per group of ``name``, its path below root, on the executors; fixtures of the readers' queries."""
    top = root.removeprefix("file://")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        path = os.path.join(top, pdf[name].iloc[0])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(encode(pdf))
        return pd.DataFrame({"path": [path]})

    rows.groupBy(name).applyInPandas(one, "path string").collect()


CLOUD = "WITH c AS (SELECT event_type, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS point_id, CAST(user_id % 500 AS DOUBLE) AS x, CAST(event_id % 101 AS DOUBLE) AS y, ROUND(value, 2) AS z, CAST(event_id % 7 AS INT) AS classification, CAST(user_id % 12 AS INT) AS tree_id FROM events)"


def _cloud(spark: SparkSession, d: str, root: str) -> None:
    e = table(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("SITE/"), "event_type", F.lit(".las")).alias("file"), "event_id", (F.col("user_id") % 500).cast("double").alias("x"), (F.col("event_id") % 101).cast("double").alias("y"), F.col("value").alias("z"),
        (F.col("event_id") % 7).cast("int").alias("classification"), (F.col("user_id") % 12).cast("int").alias("tree_id"), (F.col("event_id") % 5 + 1).cast("int").alias("intensity"), F.lit(1).alias("return_number"), F.lit(2).alias("number_of_returns"),
    )
    _files(rows, root, "file", lambda pdf: las.encode(pdf.sort_values("event_id")))


SCANNED = f"""{CLOUD} SELECT 'SITE__' || event_type AS plot, 'SITE' AS institution, point_id, x, y, z, CAST(event_id % 5 + 1 AS FLOAT) AS intensity, 1 AS return_number, 2 AS number_of_returns, classification, tree_id FROM c"""


def _two_digits(rows: DataFrame) -> DataFrame:
    return rows.withColumns({a: F.round(a, 2) for a in ("x", "y", "z")})


@query(SCANNED)
def las_scan(spark: SparkSession, d: str) -> DataFrame:
    """Clouds read by ranges of points from a folder that all tasks can open."""
    root = folder(spark)
    _cloud(spark, d, root)
    spark.dataSource.register(las.LasSource)
    return _two_digits(spark.read.format("las").option("path", root).load())


@query(f"SELECT * FROM ({SCANNED}) WHERE plot IN ('SITE__click', 'SITE__view') AND x BETWEEN 20 AND 60 AND y BETWEEN 0 AND 80")
def las_window(spark: SparkSession, d: str) -> DataFrame:
    """A window of two clouds, looked up by the headers' boxes."""
    root = folder(spark)
    _cloud(spark, d, root)
    return _two_digits(las.load(spark, root, ["SITE__click", "SITE__view"], {"x": (20, 60), "y": (0, 80)}))


@query(SCANNED)
def las_scan_by_spark(spark: SparkSession, d: str) -> DataFrame:
    """The same clouds through Spark's reader of any file system."""
    root = folder(spark)
    _cloud(spark, d, root)
    return _two_digits(las.scan(spark, root))


@query(f"{CLOUD} SELECT 'SITE' AS folder, COUNT(DISTINCT event_type) AS n_files, CAST(SUM(n) * 24 + COUNT(*) * 473 AS BIGINT) AS bytes FROM (SELECT event_type, COUNT(*) AS n FROM c GROUP BY event_type)")
def las_listing(spark: SparkSession, d: str) -> DataFrame:
    root = folder(spark)
    _cloud(spark, d, root)
    return tables.files(spark, root).groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


@query(f"{P} SELECT plot, point_id % 2 AS kind, COUNT(*) AS n, CAST(SUM(pred_id) AS BIGINT) AS ids FROM p GROUP BY ALL")
def zipped_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction arrays inside one ZIP archive per plot."""
    root = folder(spark)

    def pack(pdf: pd.DataFrame) -> bytes:
        arrays, out = io.BytesIO(), io.BytesIO()
        np.savez(arrays, semantic_pred=(pdf["point_id"] % 2).to_numpy(), instance_ids=pdf["pred_id"].to_numpy())
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"predictions/rf/{pdf['plot'].iloc[0]}_instances.npz", arrays.getvalue())
        return out.getvalue()

    _files(points(spark, d).withColumn("file", F.concat("plot", F.lit(".zip"))), root, "file", pack)
    rows = archives.arrays(archives.members(spark, root), ("semantic_pred", "instance_ids"))
    plot = F.regexp_extract("member", r"([^/]+)_instances\.npz$", 1)
    return rows.groupBy(plot.alias("plot"), F.col("semantic_pred").alias("kind")).agg(F.count("*").alias("n"), F.sum("instance_ids").alias("ids"))


@query("SELECT n_name AS plot, r_name AS folder, CASE n_nationkey % 3 WHEN 0 THEN 'test' ELSE 'dev' END AS split FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest CSV with blanks around its values, without an excluded folder."""
    root = folder(spark)
    _manifest(spark, d).withColumns({c: F.concat(F.lit(" "), c, F.lit("  ")) for c in ("path", "folder", "split")}).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    rows = tables.manifest(spark, root, ("ASIA",))
    return rows.select(F.regexp_extract("path", r"([^/]+)\.las$", 1).alias("plot"), "folder", "split")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    named = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.concat("r_name", F.lit("/"), "n_name", F.lit(".las")).alias("path"), F.col("r_name").alias("folder"), F.when(F.col("n_nationkey") % 3 == 0, "test").otherwise("dev").alias("split"))


@query("SELECT CASE n_nationkey % 3 WHEN 0 THEN 'test' ELSE 'dev' END AS split, COUNT(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1")
def present_files(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows whose file the listing has, counted by split."""
    n, r = table(spark, d, "nation").where("n_nationkey % 2 = 0"), table(spark, d, "region")
    listing = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("file:/data/"), "r_name", F.lit("/"), "n_name", F.lit(".las")).alias("path"))
    return tables.split_counts(tables.present(_manifest(spark, d), listing))


@query(f'{M} SELECT plot, method, ROUND(f1, 6) AS f1, ROUND("precision", 6) AS "precision", ROUND(recall, 6) AS recall, ROUND(coverage, 6) AS coverage, institution FROM m WHERE method IN (\'1-URGENT\', \'5-LOW\')')
def metric_files(spark: SparkSession, d: str) -> DataFrame:
    """Metric CSVs of two methods, and of one that has none, written and read back as one checked table."""
    root, m = folder(spark), metrics(spark, d)
    paths = {}
    for method in ("1-URGENT", "5-LOW"):
        paths[method] = f"{root}/{method}"
        tables.write_metrics(m.where(F.col("method") == method).drop("method"), paths[method])
    return rounded(tables.checked(tables.metrics(spark, {**paths, "3-MEDIUM": f"{root}/none"})), "f1", "precision", "recall", "coverage")


@query(f"{P} SELECT 'rf' AS method, plot, COUNT(*) AS n, CAST(SUM(pred_id) AS BIGINT) AS ids FROM p WHERE plot <> 'click' GROUP BY plot UNION ALL SELECT 'rf', plot, COUNT(*), CAST(SUM(gt_id) AS BIGINT) FROM p WHERE plot = 'click' GROUP BY plot")
def stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions by method and plot, of which one plot is written anew and replaces only itself."""
    root, p = folder(spark), points(spark, d)
    rows = lambda x, method: x.select(F.lit(method).alias("method"), "plot", "point_id", F.lit(1).alias("semantic_pred"), F.col("id").cast("int").alias("instance_id"))
    for method in ("rf", "baseline"):
        tables.write_predictions(rows(p.withColumn("id", F.col("pred_id")), method), root)
    tables.write_predictions(rows(p.where("plot = 'click'").withColumn("id", F.col("gt_id")), "rf"), root)
    return tables.predictions(spark, root, "rf").groupBy("method", "plot").agg(F.count("*").alias("n"), F.sum("instance_id").alias("ids"))


@query(f"{M}, b AS (SELECT ROUND(AVG(f1), 6) AS v, ROUND(AVG(recall), 6) AS s FROM m WHERE method = '2-HIGH') SELECT v AS voxel_size, s AS gaussian_sigma, 1e0 AS min_crown_radius_m, 3e0 AS top_band_m, 2e0 AS min_tree_height, 50 AS min_points_per_tree FROM b")
def best_params_row(spark: SparkSession, d: str) -> DataFrame:
    """A method's row of the parameter table; what it lacks comes from the defaults."""
    m = metrics(spark, d).groupBy("method").agg(r6(F.avg("f1"), "voxel_size"), r6(F.avg("recall"), "gaussian_sigma"))
    found = tables.best_params(m.orderBy("method"), "2-HIGH")
    names = ("voxel_size", "gaussian_sigma", "min_crown_radius_m", "top_band_m", "min_tree_height")
    row = (*[float(getattr(found, n)) for n in names], int(found.min_points_per_tree))
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in names) + ", min_points_per_tree int")


@query(f"{P} SELECT plot, COUNT(*) AS n, ROUND(SUM(CASE WHEN plot = 'view' THEN z * 2 ELSE z * 3 END), 3) AS total FROM p GROUP BY plot")
def feature_cache(spark: SparkSession, d: str) -> DataFrame:
    """Features of one plot are stored first; a later run computes the others and reuses these."""
    root, p = folder(spark), points(spark, d).select("plot", "point_id", "z")
    times = lambda k: lambda rows, cfg: rows.withColumn("z", F.col("z") * k)
    features.cached(p.where("plot = 'view'"), root, Features(), times(2))
    return features.cached(p, root, Features(), times(3)).groupBy("plot").agg(F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("total"))


@query("SELECT * FROM (VALUES ('features', 'k_small', '10'), ('features', 'k_large', '50'), ('watershed', 'voxel_size', '0.25'), ('watershed', 'top_band_m', '3.0'), ('forest', 'trees', '200')) t(\"group\", name, value)")
def config_values(spark: SparkSession, d: str) -> DataFrame:
    """A config file that sets two values; the others are the defaults."""
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as file:  # read on the driver, where it is written
        file.write("# an experiment\nfeatures:\n  k_small: 10  # fewer\nwatershed:\n  voxel_size: 0.25\n")
        file.flush()
        cfg = config.load(file.name)
    names = [("features", "k_small"), ("features", "k_large"), ("watershed", "voxel_size"), ("watershed", "top_band_m"), ("forest", "trees")]
    return spark.createDataFrame([(g, n, str(getattr(getattr(cfg, g), n))) for g, n in names], "group string, name string, value string")
