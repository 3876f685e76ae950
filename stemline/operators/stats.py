"""Paired tests and intervals: exact sign flips, signed ranks and the BCa bootstrap."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.config import COMPARISONS, METHODS
from stemline.functions.guards import ratio
from stemline.functions.normal import normal_cdf, normal_ppf
from stemline.operators.report import METRICS, melt
from stemline.operators.sampling import bootstrap_index

TINY = 1e-12
#: Resamples that a task draws at a time.
PART = 500
#: The exact sign test keeps 2 ** (n / 2) sums, 128 MB at this n.
MOST_SIGNS = 48
NORMAL = NormalDist()


def paired(metrics: DataFrame, first: str, second: str, value: str = "f1", method: str = "method", plot: str = "plot") -> DataFrame:
    """(plot, a, b, d = b - a) of the plots that both methods have."""
    of = lambda m, name: metrics.where(F.col(method) == m).select(plot, F.col(value).cast("double").alias(name))
    return of(first, "a").join(of(second, "b"), plot).withColumn("d", F.col("b") - F.col("a"))


def _ordered(diff: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(diff).alias("d")))), lambda x: x["d"])


def count_flips(d: list[float] | None, alternative: str = "two-sided") -> tuple[float | None, int]:
    """(observed mean, number of the 2**n sign vectors whose mean is as extreme): both halves' signed sums, one sorted and searched for the other's."""
    if d is None or any(x is None for x in d):
        return None, 0
    n, half = len(d), len(d) // 2
    if n > MOST_SIGNS:
        raise ValueError(f"the exact sign test takes at most {MOST_SIGNS} differences of a set, not {n}")

    def sums(part: list[float]) -> np.ndarray:
        s = np.zeros(1)
        for x in part:
            s = np.concatenate([s + x, s - x])
        return s

    a, b = sums(d[:half]), np.sort(sums(d[half:]))
    observed = float(np.add.accumulate(d)[-1]) / n
    at_least = lambda m: int((len(b) - np.searchsorted(b, n * m - a, "left")).sum())
    at_most = lambda m: int(np.searchsorted(b, n * m - a, "right").sum())
    if alternative == "greater":
        return observed, at_least(observed - TINY)
    if alternative != "two-sided":
        return observed, at_most(observed + TINY)
    least = abs(observed) - TINY
    return observed, at_least(least) + at_most(-least) if least > 0 else 2**n


def sign_flip_test(diffs: DataFrame, by: list[str], diff: str = "d", order: str = "plot", alternative: str = "two-sided") -> DataFrame:
    """Exact permutation test of the mean difference over all 2**n sign vectors, counted by halves in 2**(n / 2) steps.

    At most MOST_SIGNS differences a set; more raise an error.  Zero differences stay in.  Means that are equal in theory are compared with a tolerance."""
    count = F.udf(lambda d: count_flips(d, alternative), "observed double, n_extreme long")
    sets = diffs.groupBy(*by).agg(_ordered(diff, order).alias("ds")).withColumn("_c", count("ds"))
    return sets.select(*by, F.size("ds").cast("long").alias("n"), "_c.observed", F.expr("shiftleft(1L, size(ds))").alias("n_permutations"), "_c.n_extreme").withColumn("p_value", F.col("n_extreme") / F.col("n_permutations"))


def signed_ranks(diffs: DataFrame, by: list[str], diff: str = "d") -> DataFrame:
    """Non-zero differences with the average rank of their size."""
    some = diffs.where(F.col(diff) != 0).withColumn("_abs", F.abs(diff))
    tie = W.partitionBy(*by, "_abs")
    rank = F.rank().over(W.partitionBy(*by).orderBy("_abs"))
    return some.withColumn("avg_rank", rank + (F.count("*").over(tie) - 1) / 2).drop("_abs")


def count_ranks(ranks: list[int], w: int) -> float:
    """Two-sided p of a sum of at most ``w``: how many of the 2**n subsets of whole ranks have each sum."""
    ways = [1]
    for r in ranks:
        ways = [x + y for x, y in zip(ways + [0] * r, [0] * r + ways, strict=True)]
    return min(1.0, 2 * sum(ways[: w + 1]) / 2 ** len(ranks))


def wilcoxon(diffs: DataFrame, by: list[str], diff: str = "d", order: str = "plot") -> DataFrame:
    """W = min(W+, W-) and its exact two-sided p over all signs; null with a note below two non-zero pairs."""
    r = signed_ranks(diffs, by, diff)
    # doubled ranks are whole numbers, so their sums are exact
    twice = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (2 * F.col("avg_rank")).cast("long").alias("r")))), lambda x: x["r"])
    sets = r.groupBy(*by).agg(twice.alias("rs"), F.sum(F.when(F.col(diff) > 0, F.col("avg_rank")).otherwise(0.0)).alias("w_plus"), F.sum("avg_rank").alias("total"))
    sets = sets.withColumn("W", F.least("w_plus", F.col("total") - F.col("w_plus"))).where(F.size("rs") >= 2)
    p = sets.select(*by, "W", F.udf(count_ranks, "double")("rs", (2 * F.col("W")).cast("long")).alias("p_wilcoxon"))
    counts = diffs.groupBy(*by).agg(F.count("*").alias("n_plots"), F.count_if(F.col(diff) != 0).alias("n_nonzero_pairs"))
    note = F.when(F.col("n_nonzero_pairs") < 2, "too few non-zero pairs").otherwise("")
    return counts.join(p, by, "left").withColumn("note", note)


def all_pairs(metrics: DataFrame, values: list[str], comparisons: tuple[tuple[str, str], ...] = COMPARISONS, method: str = "method", plot: str = "plot") -> DataFrame:
    """(comparison, method_a, method_b, metric, plot, d) of every comparison: one join on (plot, metric)."""
    spark = metrics.sparkSession
    c = spark.createDataFrame([(f"{a} -> {b}", a, b) for a, b in comparisons], "comparison string, method_a string, method_b string")
    v = melt(metrics.select(method, plot, *[F.col(x).cast("double") for x in values]), [method, plot], values)
    left = v.join(F.broadcast(c), v[method] == c["method_a"]).select("comparison", "method_a", "method_b", plot, "metric", F.col("value").alias("a"))
    right = v.select(F.col(method).alias("method_b"), plot, "metric", F.col("value").alias("b"))
    return left.join(right, ["method_b", plot, "metric"]).select("comparison", "method_a", "method_b", "metric", plot, (F.col("b") - F.col("a")).alias("d"))


def paired_table(metrics: DataFrame, values: list[str] = ("f1", "precision", "recall"), comparisons: tuple[tuple[str, str], ...] = COMPARISONS) -> DataFrame:
    by = ["comparison", "method_a", "method_b", "metric"]
    # differences that are equal in theory tie
    d = all_pairs(metrics, list(values), comparisons).withColumn("d", F.round("d", 9))
    spread = d.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("std_diff"))
    perm = sign_flip_test(d, by).select(*by, F.col("observed").alias("perm_observed_diff"), F.col("p_value").alias("perm_p_value"), "n_permutations")
    return wilcoxon(d, by).join(spread, by).join(perm, by)


def bca(sets: DataFrame, by: list[str], n_boot: int = 10_000, level: float = 0.95, values: str = "values", seed: str = "seed") -> DataFrame:
    """(by, observed, ci_lower, ci_upper, n): bias-corrected and accelerated bootstrap of the mean of each array ``values``.

    Draws are rows: draw i of resample b takes a value by a portable index.  A set's resamples are dealt to tasks in parts, which hand on
    one sum each.  Sums are of whole billionths, so they don't depend on an order and equal ones are
    equal.  One value, or equal ones, are their own interval."""
    v, n = F.col(values), F.size(values)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    sets = sets.where(n > 0).withColumn("observed", mean).withColumn("n", n.cast("long")).withColumn("_flat", F.array_max(v) == F.array_min(v))
    # whole billionths once per set; then one row per draw, in generated code, summed within its part's task
    billionths = F.transform(v, lambda x: F.round(x * 1e9).cast("long"))
    parts = F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(PART))
    dealt = sets.where(~F.col("_flat")).select(*by, "n", F.col(seed).alias("_seed"), billionths.alias("_v"), F.explode(parts).alias("_from")).repartition(*by, "_from")
    drawn = dealt.withColumn("_b", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + PART, F.lit(n_boot)) - 1))).withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    taken = F.element_at("_v", bootstrap_index(F.col("_b"), F.col("_i"), F.col("n"), F.col("_seed")) + 1)
    sums = drawn.select(*by, "_from", "n", "_b", taken.alias("_x")).groupBy(*by, "_from", "n", "_b").agg(F.sum("_x").alias("_sum"))
    total = sets.select(*by, F.aggregate(billionths, F.lit(0).cast("long"), lambda s, x: s + x).alias("_whole"))
    wide = sums.join(total, by)
    means = F.sort_array(F.collect_list(F.col("_sum") / F.col("n") / 1e9))
    boot = wide.groupBy(*by).agg(means.alias("_boot"), F.avg((F.col("_sum") < F.col("_whole")).cast("double")).alias("_below"))
    # leave-one-out means m_i lie at (sum - x_i) / (n - 1); their distance to their mean is (x_i - mean) / (n - 1)
    power = lambda k: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow((x - F.col("observed")) / (n - 1), F.lit(float(k))))
    z = sets.join(boot, by).withColumn("_z0", normal_ppf(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_below")))))
    z = z.withColumn("_a", F.coalesce(F.try_divide(power(3), 6 * F.pow(power(2), F.lit(1.5))), F.lit(0.0)))

    def share(tail: float) -> Column:
        s = F.col("_z0") + tail
        return normal_cdf(F.coalesce(F.col("_z0") + F.try_divide(s, 1 - F.col("_a") * s), F.lit(tail)))

    def at(p: Column) -> Column:
        place = p * (n_boot - 1)
        low = F.floor(place)
        first, last = F.element_at("_boot", (low + 1).cast("int")), F.element_at("_boot", F.least(low + 2, F.lit(n_boot)).cast("int"))
        return first + (last - first) * (place - low)

    tail = NORMAL.inv_cdf((1 - level) / 2)
    placed = z.withColumn("_lo", share(tail)).withColumn("_hi", share(-tail))
    bounds = placed.select(*by, at(F.col("_lo")).alias("ci_lower"), at(F.col("_hi")).alias("ci_upper"))
    own = lambda c: F.coalesce(c, "observed").alias(c)
    return sets.join(bounds, by, "left").select(*by, "observed", own("ci_lower"), own("ci_upper"), "n")


def interval_table(metrics: DataFrame, values: tuple[str, ...] = METRICS, methods: tuple[str, ...] = METHODS, comparisons: tuple[tuple[str, str], ...] = COMPARISONS, n_boot: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Intervals of each method's metrics, then of the paired F1 differences; interval i is drawn with seed + i."""
    spark = metrics.sparkSession
    each = melt(metrics.select("method", "plot", *[F.col(v).cast("double") for v in values]), ["method", "plot"], list(values)).select(F.lit("method").alias("type"), F.col("method").alias("label"), "metric", "plot", "value")
    diff = all_pairs(metrics, ["f1"], comparisons).select(F.lit("difference").alias("type"), F.col("comparison").alias("label"), "metric", "plot", F.col("d").alias("value"))
    plan = [("method", m, v) for m in methods for v in values] + [("difference", f"{a} -> {b}", "f1") for a, b in comparisons]
    seeds = spark.createDataFrame([(*p, seed + i) for i, p in enumerate(plan)], "type string, label string, metric string, seed long")
    rows = each.unionByName(diff).where("value is not null").join(F.broadcast(seeds), ["type", "label", "metric"])
    by = ["type", "label", "metric", "seed"]
    sets = rows.groupBy(*by).agg(_ordered("value", "plot").alias("values"))
    return bca(sets, by, n_boot, level).withColumns({"n_boot": F.lit(n_boot).cast("long"), "ci_level": F.lit(level)})


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def effect(mean: str, std: str) -> Column:
    return ratio(mean, std, None)
