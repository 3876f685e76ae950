"""Metric tables, manifests, predictions, parameters and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline import schema
from stemline.config import Watershed
from stemline.operators.report import union

REQUIRED = ("plot", "method", "f1", "precision", "recall", "coverage")


class MissingBestParamsError(LookupError):
    """There is no parameter table, or no row of a method in it."""


def files(spark: SparkSession, root: str, pattern: str = "*.las") -> DataFrame:
    """(path, folder, length) of matching files below a folder, sorted; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return found.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).orderBy("path")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The split manifest without the excluded folders, names trimmed."""
    rows = spark.read.schema(schema.MANIFEST).option("header", True).csv(path)
    rows = rows.withColumns({c: F.trim(c) for c in ("path", "folder", "split")})
    return rows.where(~F.col("folder").isin(*excluded)) if excluded else rows


def present(manifest_rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose file exists: the listing's path ends with theirs."""
    names = listing.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("_tail")).distinct()
    return manifest_rows.withColumn("_tail", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)).join(names, "_tail", "left_semi").drop("_tail")


def split_counts(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.groupBy("split").agg(F.count("*").alias("n"))


def metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The metric CSVs of several methods as one table; files that don't exist are skipped, all missing raises."""
    found = []
    for method, path in paths.items():
        if exists(spark, path):
            found.append(spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("method", F.lit(method)))
    if not found:
        raise FileNotFoundError("none of the metric files exists")
    return union(found)


def checked(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The required columns; raises if one is missing.  ``institution`` is derived where it is absent."""
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    if "institution" not in rows.columns:
        from stemline.operators.labels import institution

        rows = rows.withColumn("institution", institution("plot"))
    return rows.select(*required, "institution")


def write_metrics(rows: DataFrame, path: str) -> None:
    """One small CSV with a header: metric tables have a row per plot and method."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """Replace the partitions (method, plot) that ``rows`` has, and no others."""
    rows.select(*schema.PREDICTIONS.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "plot").parquet(path)


def predictions(spark: SparkSession, path: str, method: str | None = None, plot: str | None = None) -> DataFrame:
    """Stored predictions; method and plot prune partitions."""
    rows = spark.read.schema(schema.PREDICTIONS).parquet(path)
    for name, value in (("method", method), ("plot", plot)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def missing_plots(wanted: DataFrame, done: DataFrame, method: str) -> DataFrame:
    """Plots without stored predictions of a method, by the full plot key."""
    return wanted.join(done.where(F.col("method") == method).select("plot").distinct(), "plot", "left_anti")


def upsert_best(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Best parameters with the new methods' rows in place of the old ones."""
    return new if old is None else old.join(new.select("method"), "method", "left_anti").unionByName(new, allowMissingColumns=True)


def best_params(rows: DataFrame | None, method: str, base: Watershed = Watershed()) -> Watershed:  # noqa: B008
    """A method's parameters: of several rows the one with the greatest mean_f1, then the least parameters; what the table lacks comes from ``base``."""
    names = [c for c in ("voxel_size", "gaussian_sigma", "min_crown_radius_m", "top_band_m") if rows is not None and c in rows.columns]
    order = [F.desc_nulls_last("mean_f1")] if rows is not None and "mean_f1" in rows.columns else []
    found = rows.where(F.col("method") == method).orderBy(*order, *[F.asc_nulls_last(c) for c in names]).limit(1).collect() if rows is not None else []
    if not found:
        raise MissingBestParamsError(f"no best parameters for {method}")
    row = found[0].asDict()
    return Watershed(**{**base.__dict__, **{n: float(row[n]) for n in names if row.get(n) is not None}})


#: Fixed value: the form of a training log's lines.
LOG_LINE = r"Epoch\s+(\d+)/(\d+)\s*\|\s*Train Loss[: ]+([0-9.]+).*?mIoU[: ]+([0-9.]+)"


def parse_log(lines: DataFrame, line: str = "value", pattern: str = LOG_LINE) -> DataFrame:
    """(epoch, epochs, train_loss, miou) of the lines that match."""
    got = lines.where(F.col(line).rlike(pattern))
    part = lambda i: F.regexp_extract(line, pattern, i)
    return got.select(part(1).cast("int").alias("epoch"), part(2).cast("int").alias("epochs"), part(3).cast("double").alias("train_loss"), part(4).cast("double").alias("miou"))


def log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))
