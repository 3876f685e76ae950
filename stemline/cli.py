"""Command line: ``python -m stemline.cli COMMAND``.

Points are Parquet tables or folders of LAS files; metrics, predictions and parameters are what
``stemline.sources.tables`` reads and writes.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline import config
from stemline.operators import features, labels, ml, report, stats, trees
from stemline.plans import flows
from stemline.sources import features as stored
from stemline.sources import las, tables


def load_points(spark: SparkSession, path: str, plots: list[str] | None = None) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        points = spark.read.parquet(path)
    else:
        return las.load(spark, path, plots or None)
    return points.where(F.col("plot").isin(plots)) if plots else points


def explore(spark: SparkSession, a: argparse.Namespace) -> int:
    points = load_points(spark, a.points, a.plot)
    report.profile(points, ["institution", "plot"]).orderBy("plot").show(200, False)
    report.density_by_site(points).orderBy("institution").show(200, False)
    return 0


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    """Exit status 1 if a site's plots or trees differ from the expected table."""
    points = load_points(spark, a.points).withColumn("label", labels.binary_label())
    expected = spark.read.option("header", True).schema("institution string, n_plots long, n_trees long").csv(a.expected)
    audit = report.split_audit(labels.valid(points), expected)
    audit.orderBy("institution").show(200, False)
    return int(audit.where("plots_status <> 'OK' OR trees_status <> 'OK'").count() > 0)


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg = config.load(a.config) if a.config else config.Config()
    ready = flows.prepare(load_points(spark, a.points, a.plot), cfg)
    rows = stored.cached(labels.valid(ready), a.features, cfg.features, features.extract).join(ready.select("plot", "point_id", "label"), ["plot", "point_id"])
    model = ml.train_forest(rows, cfg.forest)
    trees.save(model, a.model)
    trees.importances(trees.load(spark, a.model)).show(10, False)
    return 0


def semantic(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg = config.load(a.config) if a.config else config.Config()
    ready = flows.prepare(load_points(spark, a.points, a.plot), cfg)
    rows = stored.cached(labels.valid(ready), a.features, cfg.features, features.extract)
    pred = ml.predict_forest(trees.load(spark, a.model), rows, ready)
    tables.write_predictions(pred.select(F.lit("rf_semantic").alias("method"), "plot", "point_id", "semantic_pred", F.lit(0).alias("instance_id")), a.predictions)
    return 0


def _prepared(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame | None, config.Config]:
    cfg = config.load(a.config) if a.config else config.Config()
    ready = flows.prepare(load_points(spark, a.points, a.plot), cfg)
    filter_ = config.DESIGN[a.method][0]
    return ready, None if filter_ == "none" else tables.predictions(spark, a.predictions, f"{filter_}_semantic"), cfg


def grid(spark: SparkSession, a: argparse.Namespace) -> int:
    ready, pred, cfg = _prepared(spark, a)
    summary, best = flows.tune(ready, a.method, pred, cfg=cfg)
    tables.write_metrics(summary, f"{a.output}/grid_{a.method}")
    # a partition per method: the rows of other methods are neither read nor written
    best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(f"{a.output}/best_params")
    return 0


def instance(spark: SparkSession, a: argparse.Namespace) -> int:
    ready, pred, cfg = _prepared(spark, a)
    best = spark.read.parquet(a.best) if tables.exists(spark, a.best) else None
    tables.write_metrics(flows.run_stage(ready, a.method, f"{a.output}/instances", best, pred, cfg), f"{a.output}/metrics_{a.method}")
    return 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = tables.metrics(spark, {m: f"{a.input}/metrics_{m}" for m in a.methods})
    report.summarise(rows, ["method", "institution"], ["f1", "precision", "recall", "coverage"], ["n_gt_trees", "n_pred_trees"]).orderBy("method", "institution").show(200, False)
    tables.write_metrics(rows, f"{a.output}/comparison")
    print(report.latex(rows, ["precision", "recall", "f1", "coverage"]))
    return 0


def _comparison(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return tables.checked(spark.read.option("header", True).option("inferSchema", True).csv(a.input))


def statistics(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _comparison(spark, a)
    paired = stats.paired_table(rows)
    paired.withColumn("sig", report.stars(F.col("perm_p_value"))).show(100, False)
    for name, df in (("descriptive_stats", report.describe(rows, list(report.METRICS))), ("paired_tests", paired), ("bootstrap_ci", stats.interval_table(rows))):
        tables.write_metrics(df, f"{a.output}/{name}")
    return 0


def sites(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _comparison(spark, a)
    loo = report.leave_one_out(rows)
    claims = {"density_helps_rf": ("rf", "rf_density"), "density_helps_pointnet2": ("pointnet2", "pointnet2_density"), "rf_beats_pointnet2": ("pointnet2_density", "rf_density")}
    for name, df in (("leave_one_site_out", loo), ("ranking_stability", report.rank_stability(loo)), ("site_impact", report.site_impact(rows, a.site)), ("conclusions", report.conclusions(loo, claims, "excluded_site"))):
        df.show(100, False)
        tables.write_metrics(df, f"{a.output}/{name}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stemline", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(required=True)

    def command(f, *options: str, **more):  # noqa: ANN001, ANN202
        c = sub.add_parser(f.__name__, help=(f.__doc__ or "").strip() or None)
        c.set_defaults(run=f)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        for o, kw in more.items():
            c.add_argument(f"--{o}", **kw)

    plot, cfg = {"nargs": "*"}, {"default": None}
    method = {"choices": config.METHODS, "required": True}
    command(explore, "points", plot=plot)
    command(verify, "points", "expected")
    command(train, "points", "features", "model", plot=plot, config=cfg)
    command(semantic, "points", "features", "model", "predictions", plot=plot, config=cfg)
    command(grid, "points", "output", method=method, predictions=cfg, plot=plot, config=cfg)
    command(instance, "points", "output", "best", method=method, predictions=cfg, plot=plot, config=cfg)
    command(evaluate, "input", "output", methods={"nargs": "+", "default": list(config.METHODS)})
    command(statistics, "input", "output")
    command(sites, "input", "output", site={"default": "NIBIO"})
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("stemline").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
