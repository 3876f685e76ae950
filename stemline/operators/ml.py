"""Point classifiers: a random forest on features, and block inference with any scorer.

A scorer is a function from a batch of blocks (n, points, 5) to probabilities (n, points, 2): ``network.scorer`` is the
hierarchical network, ``perceptron_scorer`` a small one on single points.  The network's two building blocks, set
abstraction at several scales and feature propagation, are relational here, with weights as parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemline.config import Blocks, Forest
from stemline.operators import labels, neighbors, sampling, semantic, trees
from stemline.operators.features import NAMES

Scorer = Callable[[np.ndarray], np.ndarray]


def train_forest(features: DataFrame, cfg: Forest = Forest(), names: tuple[str, ...] = NAMES, by: str = "plot") -> DataFrame:  # noqa: B008
    """The nodes of a forest on at most ``max_samples_per_class`` points of each plot and class, classes weighted to balance.

    ``features`` has ``label`` in {0, 1}.  Splits are exact."""
    sample = sampling.cap_per_class(labels.valid(features), cfg.max_samples_per_class, (by, "label"), seed=cfg.seed)
    keyed = sample.withColumn("_key", F.concat_ws("|", by, "point_id"))
    return trees.train(keyed, names, cfg.trees, seed=cfg.seed, max_depth=cfg.max_depth, key="_key")


def predict_forest(nodes: DataFrame, features: DataFrame, points: DataFrame, names: tuple[str, ...] = NAMES, by: str = "plot") -> DataFrame:
    """(by, point_id, semantic_pred, p0, p1) of all ``points``: -1 and zeros where a point has no features."""
    part = trees.predict(nodes, features, names, (by, "point_id"))
    return labels.scatter(points.select(by, "point_id"), part, {"semantic_pred": -1, "p0": 0.0, "p1": 0.0}, (by, "point_id"))


def centred(points: DataFrame, by: str = "plot") -> DataFrame:
    """x and y about the middle of the valid points (of all where none is), heights over 50 in [0, 1]."""
    ok = F.col("label") != -1
    mid = points.groupBy(by).agg(*[F.coalesce(F.avg(F.when(ok, F.col(a))), F.avg(a)).alias(f"_{a}") for a in ("x", "y")])
    hag = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("hag") / 50))
    return points.join(mid, by).withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y"), "hag": hag.cast("float")}).drop("_x", "_y")


def block_probabilities(points: DataFrame, scorer: Scorer, n_passes: int, cfg: Blocks = Blocks(), by: str = "plot", seed: int = 42) -> DataFrame:  # noqa: B008
    """(by, point_id, p0, p1) for every point and pass in which it was sampled."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy(float)
        x = x - x.mean(0)
        x = x / (np.sqrt((x**2).sum(1)).max() + 1e-8)
        p = scorer(np.concatenate([x, pdf[["hag", "intensity"]].to_numpy(float)], 1)[None].astype(np.float32))[0]
        return pdf[[by, "point_id"]].assign(p0=p[:, 0].astype(float), p1=p[:, 1].astype(float))

    blocks = sampling.pass_blocks(centred(points, by), n_passes, cfg.points, by, seed=seed)
    return blocks.groupBy(by, "pass").applyInPandas(one, f"{by} string, point_id long, p0 double, p1 double")


def block_inference(points: DataFrame, scorer: Scorer, n_passes: int, radius: float, cfg: Blocks = Blocks(), by: str = "plot", seed: int = 42) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(predictions of all points, coverage per plot): sampled means, interpolated where a point was never sampled."""
    merged = semantic.merge_probabilities(block_probabilities(points, scorer, n_passes, cfg, by, seed), [by, "point_id"])
    everything = points.select(by, "point_id", "x", "y", "z").join(merged.drop("semantic_pred"), [by, "point_id"], "left")
    covered, bare = everything.where("n_samples is not null"), everything.where("n_samples is null")
    filled = neighbors.interpolate(bare, covered, radius, 3, by=by)
    both = covered.select(by, "point_id", "p0", "p1").unionByName(filled.select(by, "point_id", "p0", "p1"))
    pred = both.withColumn("semantic_pred", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0))
    whole = labels.scatter(points.select(by, "point_id"), pred, {"semantic_pred": 0, "p0": 1.0, "p1": 0.0}, (by, "point_id"))
    return whole, semantic.coverage(everything.withColumn("n_samples", F.coalesce("n_samples", F.lit(0))), [by])


def layer(inputs: list[Column], weights: list[list[float]], bias: list[float]) -> list[Column]:
    """A dense layer with rectified outputs in built-in expressions: one output per row of ``weights``."""
    return [F.greatest(F.lit(0.0), reduce(lambda s, t: s + t, [x * float(w) for x, w in zip(inputs, row, strict=True)], F.lit(float(b)))) for row, b in zip(weights, bias, strict=True)]


def set_abstraction(points: DataFrame, scales: list[tuple[float, int, list[list[float]], list[float]]], n_centres: int, features: tuple[str, ...] = (), axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id", seed: int = 42) -> DataFrame:
    """(by, key, channels array<double>) of farthest points: per scale (radius, members, weights, bias) the greatest output of
    a shared layer over the members of each ball, the scales side by side.

    A layer reads a member's offset from the centre and its ``features``; balls are joins and the
    maxima are combined before they are shuffled."""
    centres = points.join(neighbors.farthest_points(points, n_centres, axes, by, key, seed).select(by, key), [by, key]).select(by, key, *axes)
    named = points.select(by, F.col(key).alias("_m"), *[F.col(a).alias(f"_{a}") for a in axes], *features)
    out = centres.select(by, key)
    for i, (radius, n, weights, bias) in enumerate(scales):
        balls = neighbors.ball_query(centres, points, radius, n, axes, by, key).withColumn("_m", F.explode("members"))
        rows = balls.join(named, [by, "_m"]).join(centres, [by, key])
        inputs = [F.col(f"_{a}") - F.col(a) for a in axes] + [F.col(f) for f in features]
        best = rows.groupBy(by, key).agg(F.array(*[F.max(c) for c in layer(inputs, weights, bias)]).alias(f"_s{i}"))
        out = out.join(best, [by, key])
    return out.select(by, key, F.flatten(F.array(*[F.col(f"_s{i}") for i in range(len(scales))])).alias("channels"))


def propagate(points: DataFrame, centres: DataFrame, weights: list[list[float]], bias: list[float], radius: float, features: tuple[str, ...] = (), axes: tuple[str, ...] = ("x", "y", "z"), by: str = "plot", key: str = "point_id") -> DataFrame:
    """(by, key, channels) of ``points``: channels of the three nearest of ``centres`` (by, key, axes, channels) by inverse
    squared distance, beside the point's own ``features``, through a layer."""
    width = len(weights[0]) - len(features)
    names = [f"_c{i}" for i in range(width)]
    wide = centres.select(by, key, *axes, *[F.col("channels")[i].alias(c) for i, c in enumerate(names)])
    near = neighbors.interpolate(points, wide, radius, 3, tuple(names), axes, by, key, squared=True)
    joined = near.join(points.select(by, key, *features), [by, key]) if features else near
    return joined.select(by, key, F.array(*layer([F.col(c) for c in (*names, *features)], weights, bias)).alias("channels"))


def perceptron_scorer(x: np.ndarray, y: np.ndarray, hidden: int = 16, steps: int = 300, seed: int = 42) -> Scorer:
    """A two-layer perceptron on single points (n, 5), trained with class weights."""
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 0.5, (x.shape[1], hidden)), np.zeros(hidden)
    w2, b2 = rng.normal(0, 0.5, (hidden, 2)), np.zeros(2)
    weight = len(y) / (2 * np.bincount(y, minlength=2) + 1e-6)

    def forward(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(v @ w1 + b1)
        s = h @ w2 + b2
        e = np.exp(s - s.max(-1, keepdims=True))
        return h, e / e.sum(-1, keepdims=True)

    for _ in range(steps):
        at = rng.integers(0, len(x), 256)
        h, p = forward(x[at])
        d = p.copy()
        d[np.arange(len(at)), y[at]] -= 1
        d *= (weight[y[at]] / len(at))[:, None]
        back = (d @ w2.T) * (1 - h * h)
        w2 -= 0.3 * h.T @ d
        b2 -= 0.3 * d.sum(0)
        w1 -= 0.3 * x[at].T @ back
        b1 -= 0.3 * back.sum(0)
    return lambda blocks: forward(blocks)[1]
