"""Farthest-point sampling of plots of any size, exactly as the plain loop takes them.

Points lie in buckets between quantiles of their axes.  A task sees a plot only as its buckets: box, farthest point
and an upper bound of the distance to the samples.  It takes samples as long as the
farthest bucket is untouched by those it has taken since; then the buckets that they may have changed, and that
may hold the next, are opened in one pass over their points, against the samples that their box can be near to.
Later rounds take ever more samples, for each touches a smaller part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemline.functions.draws import draw
from stemline.operators.neighbors import finite
from stemline.operators.selection import order_statistics
from stemline.sources.shared import keep, release

SAMPLE = -1


def _bucketed(points: DataFrame, axes: tuple[str, ...], by: str, key: str, buckets: int) -> DataFrame:
    """(by, key, c0.., bucket): at most ``buckets`` a plot, cut at approximate quantiles, on which no result depends."""
    per = max(2, int(buckets ** (1 / len(axes))))
    names = [f"c{i}" for i in range(len(axes))]
    placed = finite(points, axes).select(by, F.col(key).cast("long").alias(key), *[F.col(a).cast("double").alias(n) for a, n in zip(axes, names, strict=True)])
    shares = [j / per for j in range(1, per)]
    cuts = placed.groupBy(by).agg(*[F.percentile_approx(n, shares, 1000).alias(f"_{n}") for n in names])
    slab = lambda n: F.size(F.filter(f"_{n}", lambda c: c <= F.col(n))).cast("long")
    number = reduce(lambda code, n: code * per + slab(n), names, F.lit(0).cast("long"))
    return placed.join(cuts, by).select(by, key, *names, number.alias("bucket"))


def farthest_points(points: DataFrame, n: int, axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id", seed: int = 42, buckets: int = 4096) -> DataFrame:
    """(by, rank, key): n points per plot, each the farthest from those before, the lower id of equals; the start is drawn by the seed.

    ``key`` is a whole number and distinct in its plot.  Points without a place are left out; a plot with fewer than n
    points gives all, and once only copies of taken places are left, its lowest id again and again."""
    axis = range(len(axes))
    store = keep(_bucketed(points, axes, by, key, buckets))
    counts = store.groupBy(by).agg(F.count("*").alias("n"))
    start = order_statistics(store, counts.select(by, F.floor(draw(seed, by) * F.col("n")).alias("rank")), key, by).drop("rank")
    places = [f"c{i}" for i in axis]
    boxes = store.groupBy(by, "bucket").agg(*[F.min(c).alias(f"lo{c}") for c in places], *[F.max(c).alias(f"hi{c}") for c in places])
    whole = boxes.withColumns({"bound": F.lit(float("inf")), "rank": F.lit(0), key: F.lit(0).cast("long"), "stale": F.lit(True), **{c: F.lit(0.0) for c in places}})
    first = store.join(start, [by, key]).withColumns({"bucket": F.lit(SAMPLE).cast("long"), "bound": F.lit(0.0), "rank": F.lit(0), "stale": F.lit(False), **{f"{side}{c}": F.lit(0.0) for side in ("lo", "hi") for c in places}})
    names = [by, "bucket", "rank", key, "bound", "stale", *places, *[f"lo{c}" for c in places], *[f"hi{c}" for c in places]]
    state = whole.select(names).unionByName(first.select(names)).join(counts.select(by, F.least("n", F.lit(n)).cast("int").alias("want")), by)
    kinds = {by: store.schema[by].dataType.simpleString(), "bucket": "long", "rank": "int", key: "long", "stale": "boolean", "want": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in [*names, "want"]) + ", near array<array<double>>"

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, pdf = pdf[pdf["bucket"] == SAMPLE].sort_values("rank"), pdf[pdf["bucket"] != SAMPLE].reset_index(drop=True)
        at, low, high = (pdf[[f"{side}{c}" for c in places]].to_numpy(float) for side in ("", "lo", "hi"))
        bound, stale, keys = pdf["bound"].to_numpy(float).copy(), pdf["stale"].to_numpy(bool).copy(), pdf[key].to_numpy()
        want = int(pdf["want"].iloc[0])
        samples = [tuple(r) for r in taken[places].to_numpy(float)]
        new = []
        squares = lambda d: reduce(np.add, [d[:, i] * d[:, i] for i in axis])
        while len(samples) < want and not stale.all():
            fresh = np.flatnonzero(~stale)
            best = fresh[np.lexsort((keys[fresh], -bound[fresh]))[0]]
            if stale.any() and bound[stale].max() >= bound[best]:
                break
            new.append({by: pdf[by].iloc[0], "bucket": SAMPLE, "rank": len(samples), key: keys[best], **{c: at[best, i] for i, c in enumerate(places)}})
            s = at[best]
            samples.append(tuple(s))
            nearest, far = squares(np.maximum(np.maximum(low - s, s - high), 0)), squares(np.maximum(np.abs(low - s), np.abs(high - s)))
            touched = nearest < bound
            bound = np.where(touched, np.minimum(bound, far), bound)
            stale |= touched
        # buckets that may hold the next, and those within half its distance, which soon may
        open_ = stale & (4 * bound >= bound.max()) if len(samples) < want else np.zeros(len(pdf), bool)
        near: list[list | None] = [None] * len(pdf)
        points = np.array(samples)
        for i in np.flatnonzero(open_):
            reach = squares(np.maximum(np.maximum(low[i] - points, points - high[i]), 0)) <= bound[i]
            near[i] = points[reach].tolist()
        rows = pdf.assign(bound=bound, stale=stale, near=near)
        kept = taken[[by, "bucket", "rank", key, *places]]
        if new:
            kept = pd.concat([kept, pd.DataFrame(new)])
        kept = kept.assign(bound=0.0, stale=False, want=want, near=None, **{f"{side}{c}": 0.0 for side in ("lo", "hi") for c in places})
        return pd.concat([rows, kept])[[*names, "want", "near"]]

    def apart(s: Column) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(c) - s[i]) * (F.col(c) - s[i]) for i, c in enumerate(places)])

    before = None
    while True:
        now = keep(state.groupBy(by).applyInPandas(take, schema))
        wanted = now.where("near IS NOT NULL").select(by, "bucket", "near")
        if before is not None:
            release(before)
        if wanted.isEmpty():
            break
        d = F.array_min(F.transform("near", apart))
        top = store.join(wanted, [by, "bucket"]).groupBy(by, "bucket").agg(F.max(F.struct(d.alias("d"), (-F.col(key)).alias("k"), *places)).alias("top"))
        opened = now.join(top, [by, "bucket"], "left")
        fresh = {"bound": F.coalesce("top.d", "bound"), key: F.coalesce(-F.col("top.k"), F.col(key)), "stale": F.col("stale") & F.col("top").isNull(), **{c: F.coalesce(f"top.{c}", c) for c in places}}
        state, before = opened.withColumns(fresh).select(*names, "want"), now
    out = keep(now.where(f"bucket = {SAMPLE}").select(by, "rank", key))
    release(now, store)
    return out
