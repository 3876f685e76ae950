"""Group reports, rankings and leave-one-site-out analysis on metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.config import METHODS
from stemline.functions.guards import ratio

METRICS = ("f1", "precision", "recall", "coverage")


def union(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns differ; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def melt(metrics: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return metrics.unpivot(keys, columns, "metric", "value")


def describe(metrics: DataFrame, columns: list[str], by: str = "method") -> DataFrame:
    """Mean, sample deviation, median, extremes and count of each metric per method; nulls don't count."""
    v = melt(metrics.select(by, *[F.col(c).cast("double") for c in columns]), [by], columns).where("value is not null")
    return v.groupBy(by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n")
    )


def summarise(metrics: DataFrame, by: list[str], means: list[str], sums: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def site_spread(metrics: DataFrame, value: str = "f1", by: str = "institution") -> DataFrame:
    """Mean and population deviation per site."""
    return metrics.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def leave_one_out(metrics: DataFrame, value: str = "f1", site: str = "institution", method: str = "method", plot: str = "plot") -> DataFrame:
    """(excluded_site, n_plots_remaining, method, mean_f1, std_f1) without each site in turn, and with all as ``none``.

    Sites are a small dimension: metrics are summed per (site, method) first, and only these sums meet
    the sites."""
    v = F.col(value).cast("double")
    part = metrics.groupBy(site, method).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count(v).alias("c"))
    plots = metrics.groupBy(site).agg(F.countDistinct(plot).alias("p"))
    left_out = metrics.select(F.col(site).alias("excluded_site")).distinct().unionByName(metrics.sparkSession.range(1).select(F.lit("none").alias("excluded_site")))
    kept = F.col("excluded_site") != F.col(site)
    n = left_out.join(plots, kept, "left").groupBy("excluded_site").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_plots_remaining"))
    s = left_out.join(part, kept).groupBy("excluded_site", method).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("c").alias("c"))
    spread = F.sqrt(F.greatest(ratio(F.col("q") - ratio(F.col("s") * F.col("s"), "c"), F.col("c") - 1, None), F.lit(0.0)))
    return s.join(n, "excluded_site").select("excluded_site", "n_plots_remaining", method, ratio("s", "c", None).alias("mean_f1"), F.when(F.col("c") > 1, spread).alias("std_f1"))


def ranked(loo: DataFrame, method: str = "method") -> DataFrame:
    order = W.partitionBy("excluded_site").orderBy(F.desc("mean_f1"), method)
    return loo.withColumn("rank", F.row_number().over(order))


def rank_stability(loo: DataFrame, slots: int = 5, method: str = "method") -> DataFrame:
    """The methods in order of their mean per exclusion, and whether those in common change order against the full table."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(method).alias("m"))))
    lists = ranked(loo, method).groupBy("excluded_site").agg(F.max("n_plots_remaining").alias("n_plots"), F.transform(items, lambda x: x["m"]).alias("order"))
    full = lists.where("excluded_site = 'none'").select(F.col("order").alias("full_order"))
    # one row
    both = lists.join(F.broadcast(full), how="left")
    common = lambda a, b: F.filter(a, lambda x: F.array_contains(b, x))
    changed = common(F.col("order"), F.col("full_order")) != common(F.col("full_order"), F.col("order"))
    ranks = [F.coalesce(F.get("order", F.lit(i)), F.lit("—")).alias(f"rank_{i + 1}") for i in range(slots)]
    return both.select("excluded_site", "n_plots", *ranks, changed.alias("ranking_changed"))


def site_impact(metrics: DataFrame, out: str, methods: tuple[str, ...] = METHODS, value: str = "f1", site: str = "institution", method: str = "method", plot: str = "plot") -> DataFrame:
    """Mean with and without one site per method, their difference and percent change."""
    spark = metrics.sparkSession
    order = spark.createDataFrame([(i, m) for i, m in enumerate(methods)], f"_i int, {method} string")
    away = F.col(site) != out
    m = metrics.groupBy(method).agg(
        F.avg(value).alias("f1_with"), F.avg(F.when(away, F.col(value))).alias("f1_without"), F.countDistinct(plot).alias("n_plots_with"), F.countDistinct(F.when(away, F.col(plot))).alias("n_plots_without")
    )
    delta = F.col("f1_without") - F.col("f1_with")
    return order.join(m, method, "left").orderBy("_i").select(method, "f1_with", "f1_without", delta.alias("delta"), ratio(100 * delta, "f1_with").alias("pct_change"), "n_plots_with", "n_plots_without")


def conclusions(means: DataFrame, claims: dict[str, tuple[str, str]], by: str = "scenario", method: str = "method", value: str = "mean_f1") -> DataFrame:
    """Per scenario whether each claim, that the second method's mean exceeds the first's, holds; a missing mean is 0."""
    names = sorted({m for pair in claims.values() for m in pair})
    wide = means.groupBy(by).pivot(method, names).agg(F.first(value))
    get = lambda m: F.coalesce(F.col(f"`{m}`"), F.lit(0.0))
    return wide.select(by, *[(get(b) > get(a)).alias(c) for c, (a, b) in claims.items()])


def pivot_mean(metrics: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    return metrics.groupBy(row).pivot(column, values).agg(F.avg(value))


def ordered_means(metrics: DataFrame, columns: list[str], methods: tuple[str, ...] = METHODS, method: str = "method") -> DataFrame:
    """Means per method in the given order; a method without rows has nulls."""
    order = metrics.sparkSession.createDataFrame([(i, m) for i, m in enumerate(methods)], f"position int, {method} string")
    return order.join(metrics.groupBy(method).agg(*[F.avg(c).alias(c) for c in columns]), method, "left").orderBy("position")


def marginal_best(grid: DataFrame, parameter: str, value: str = "mean_f1") -> DataFrame:
    """The greatest mean per value of a parameter, and whether it is the best of all (the least value on ties)."""
    top = grid.groupBy(parameter).agg(F.max(value).alias("best"))
    first = W.partitionBy().orderBy(F.desc("best"), parameter)
    return top.withColumn("chosen", F.row_number().over(first) == 1)


def density_by_site(points: DataFrame, site: str = "institution", plot: str = "plot") -> DataFrame:
    """Least, median and greatest points per area of the plots of each site and of all; plots without extent are left out."""
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    per = points.groupBy(site, plot).agg(F.count("*").alias("n"), area.cast("double").alias("area")).where("area > 0").withColumn("density", F.col("n") / F.col("area"))
    stats = per.rollup(site).agg(F.grouping(site).alias("g"), F.count("*").alias("n_plots"), F.min("density").alias("min"), F.median("density").alias("median"), F.max("density").alias("max"))
    return stats.select(F.when(F.col("g") == 1, "GLOBAL").otherwise(F.col(site)).alias(site), "n_plots", "min", "median", "max")


def profile(points: DataFrame, by: list[str]) -> DataFrame:
    """Size, distinct trees, extents, density and height range of a cloud, with its warnings."""
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    p = points.groupBy(*by).agg(
        F.count("*").alias("n_points"), F.countDistinct(F.when(F.col("tree_id") > 0, F.col("tree_id"))).alias("n_trees"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
        area.cast("double").alias("area"), F.max(F.col("classification") != 0).alias("_classed"),
    )
    warnings = F.array_compact(F.array(F.when(F.col("n_trees") == 0, F.lit("no trees")), F.when(~F.col("_classed"), F.lit("no classes")), F.when(F.col("area") <= 0, F.lit("no extent"))))
    return p.withColumn("density", ratio("n_points", "area")).withColumn("warnings", F.array_join(warnings, "; ")).drop("_classed")


def split_audit(points: DataFrame, expected: DataFrame, site: str = "institution") -> DataFrame:
    """Plots and trees per site against ``expected`` (site, n_plots, n_trees); sites of one side only are reported too."""
    seen = points.groupBy(site).agg(F.countDistinct("plot").alias("plots"), F.countDistinct(F.when(F.col("tree_id") > 0, F.struct("plot", "tree_id"))).alias("trees"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    both = seen.join(expected, site, "full_outer").select(site, *[zero(F.col(c)).alias(c) for c in ("plots", "trees", "n_plots", "n_trees")])
    dp, dt = F.col("plots") - F.col("n_plots"), F.col("trees") - F.col("n_trees")
    text = lambda d: F.when(d == 0, F.lit("OK")).otherwise(F.format_string("MISMATCH(%+d)", d))
    return both.select(site, "plots", "trees", text(dp).alias("plots_status"), text(dt).alias("trees_status"))


def site_share(metrics: DataFrame, chosen: str, site: str = "institution", plot: str = "plot") -> DataFrame:
    n = metrics.agg(F.countDistinct(F.when(F.col(site) == chosen, F.col(plot))).alias("n_site"), F.countDistinct(plot).alias("n_all"))
    return n.select("n_site", "n_all", ratio("n_site", "n_all").alias("share"))


def first_best(rows: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The row with the greatest value, the first in ``order`` of equals: a total order, unlike max_by."""
    if not by:
        return rows.orderBy(F.desc(value), *order).limit(1)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), *order))).where("_r = 1").drop("_r")


def importances(model_importances: list[float], names: list[str], spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(list(zip(names, map(float, model_importances), strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def rough_density(rows: DataFrame, n: str, area: float = 30_000.0, site: str = "institution") -> DataFrame:
    """Points of each site over an assumed area."""
    return rows.groupBy(site).agg((F.sum(n) / F.lit(area)).alias("density"), F.sum(n).alias("n"))


def verdict(p: Column, mean_diff: Column) -> Column:
    """What a comparison's p value and mean difference say."""
    way = F.when(mean_diff > 0, "second is higher").when(mean_diff < 0, "first is higher").otherwise("no difference")
    return F.when(p < 0.05, F.concat(F.lit("significant: "), way)).when(p < 0.10, F.concat(F.lit("marginal: "), way)).otherwise(F.concat(F.lit("not significant: "), way))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def latex(metrics: DataFrame, columns: list[str], methods: tuple[str, ...] = METHODS, method: str = "method") -> str:
    """A LaTeX table of means with a row for each of ``methods``."""
    rows = ordered_means(metrics, columns, methods, method).collect()
    head = " & ".join([method, *columns]).replace("_", r"\_")
    body = "\n".join(" & ".join([str(r[method]).replace("_", r"\_"), *["--" if r[c] is None else f"{r[c]:.3f}" for c in columns]]) + r" \\" for r in rows)
    return "\\begin{tabular}{l" + "r" * len(columns) + "}\n\\hline\n" + head + " \\\\\n\\hline\n" + body + "\n\\hline\n\\end{tabular}\n"
