"""A hierarchical point network: set abstraction at several scales, feature propagation with skip links, and its training.

A block of points has five channels (x, y, z, height, intensity).  Each level of the encoder draws farthest
points as centres and gives each, per scale, the greatest outputs of shared layers over the members of its ball; the
decoder carries features back level by level from the three nearest centres, beside the finer level's own; a head ends
in log-probabilities.  All layers have normalisation folded into their weights and rectify, but for the last.

Weights are a table (name, shape, values).  Forward passes and gradients are array code over one block in a
task; Spark deals the blocks.  A training step sums the gradients of its blocks in whole numbers of 2**-32, which don't depend on an order,
first within tasks and then in groups of tasks, so that any number of partitions has the same result;
the driver holds one gradient and the weights, whose size is the network's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.functions.draws import draw_of
from stemline.operators import sampling
from stemline.sources.shared import keep, release
from stemline.sources.tables import exists

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Level:
    """``centres`` farthest points, and (radius, members, widths of the shared layers) of each scale."""

    centres: int
    scales: tuple[tuple[float, int, tuple[int, ...]], ...]


@dataclass(frozen=True)
class Shape:
    """The levels and widths of the full network."""

    levels: tuple[Level, ...] = (
        Level(1024, ((0.1, 16, (16, 16, 32)), (0.2, 32, (32, 32, 64)))),
        Level(256, ((0.2, 16, (64, 64, 128)), (0.4, 32, (64, 96, 128)))),
        Level(64, ((0.4, 16, (128, 128, 256)), (0.8, 32, (128, 128, 256)))),
        Level(16, ((0.8, 16, (256, 256, 512)), (1.6, 32, (256, 384, 512)))),
    )
    #: From the coarsest level back to the points.
    back: tuple[tuple[int, ...], ...] = ((512, 512), (512, 256), (256, 128), (128, 128))
    head: int = 64
    classes: int = 2
    inputs: int = 5

    def layers(self) -> list[tuple[str, int, int]]:
        """(name, inputs, outputs) of every layer in order."""
        out, wide = [], [self.inputs]
        for i, level in enumerate(self.levels):
            for s, (_, _, widths) in enumerate(level.scales):
                for k, (a, b) in enumerate(zip((wide[-1] + 3, *widths), widths, strict=False)):
                    out.append((f"down{i}.{s}.{k}", a, b))
            wide.append(sum(w[-1] for _, _, w in level.scales))
        below = wide[-1]
        for i, widths in enumerate(self.back):
            for k, (a, b) in enumerate(zip((wide[-2 - i] + below, *widths), widths, strict=False)):
                out.append((f"up{i}.{k}", a, b))
            below = widths[-1]
        return [*out, ("head.0", below, self.head), ("head.1", self.head, self.classes)]


def fresh(shape: Shape, seed: int = 42) -> Weights:
    """Uniform weights within the inverse root of a layer's inputs, zero biases."""
    rng, out = np.random.default_rng(seed), {}
    for name, a, b in shape.layers():
        out[f"{name}.w"], out[f"{name}.b"] = rng.uniform(-1, 1, (b, a)) / math.sqrt(a), np.zeros(b)
    return out


def to_table(spark: SparkSession, weights: Weights) -> DataFrame:
    return spark.createDataFrame([(n, list(w.shape), w.ravel().tolist()) for n, w in sorted(weights.items())], "name string, shape array<int>, `values` array<double>")


def from_table(rows: DataFrame) -> Weights:
    """The weights of a table; their size is the network's."""
    return {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in rows.select("name", "shape", "values").collect()}


# --- geometry: what doesn't depend on weights --------------------------------------------------------


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(a.shape[1]))


def farthest(x: np.ndarray, n: int, start: int) -> np.ndarray:
    """Indices of n points, each the first farthest from those before it."""
    least, at, taken = np.full(len(x), np.inf), start, []
    for _ in range(min(n, len(x))):
        taken.append(at)
        least = np.minimum(least, ((x - x[at]) ** 2).sum(1))
        at = int(least.argmax())
    return np.array(taken)


def ball(x: np.ndarray, centres: np.ndarray, radius: float, n: int) -> np.ndarray:
    """(centres, n) indices of the first points in order within the radius, padded with the first."""
    near = square_distances(centres, x) <= radius * radius
    rank = np.cumsum(near, 1)
    out = np.repeat(near.argmax(1)[:, None], n, 1)
    row, col = np.nonzero(near & (rank <= n))
    out[row, rank[row, col] - 1] = col
    return out


def three_nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of up to three nearest centres by inverse squared distance; one centre alone has all the weight."""
    d = square_distances(x, centres)
    at = np.argsort(d, 1, kind="stable")[:, :3]
    w = 1 / (np.take_along_axis(d, at, 1) + 1e-8)
    return at, w / w.sum(1, keepdims=True)


@dataclass
class Geometry:
    """Places, balls and nearest centres of a block at every level."""

    xyz: list[np.ndarray] = field(default_factory=list)
    balls: list[list[np.ndarray]] = field(default_factory=list)
    nearest: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def of(x: np.ndarray, shape: Shape, draw: float = 0.0) -> Geometry:
        """``draw`` in [0, 1) gives the first centre of every level."""
        g = Geometry([x[:, :3]])
        for level in shape.levels:
            here = g.xyz[-1]
            at = farthest(here, level.centres, int(draw * len(here)))
            g.xyz.append(here[at])
            g.balls.append([ball(here, here[at], r, n) for r, n, _ in level.scales])
            g.nearest.append(three_nearest(here, here[at]))
        return g


# --- forward and backward ----------------------------------------------------------------------------


class Run:
    """One block's forward pass, remembered for its gradients."""

    def __init__(self, shape: Shape, weights: Weights, x: np.ndarray, geometry: Geometry):
        self.shape, self.weights, self.geometry = shape, weights, geometry
        self.inputs: dict[str, np.ndarray] = {}
        self.positive: dict[str, np.ndarray] = {}
        self.argmax: dict[str, np.ndarray] = {}
        levels = [x]
        for i, level in enumerate(shape.levels):
            parts = []
            for s, (_, _, widths) in enumerate(level.scales):
                members = geometry.balls[i][s]
                offset = geometry.xyz[i][members] - geometry.xyz[i + 1][:, None, :]
                out = self._layers(f"down{i}.{s}", len(widths), np.concatenate([levels[-1][members], offset], 2))
                self.argmax[f"down{i}.{s}"] = out.argmax(1)
                parts.append(out.max(1))
            levels.append(np.concatenate(parts, 1))
        below = levels[-1]
        self.split: list[int] = []
        for i, widths in enumerate(shape.back):
            k = len(shape.levels) - 1 - i
            at, w = geometry.nearest[k]
            self.split.append(levels[k].shape[1])
            below = self._layers(f"up{i}", len(widths), np.concatenate([levels[k], (below[at] * w[:, :, None]).sum(1)], 1))
        z = self._layer("head.1", self._layer("head.0", below), False)
        z = z - z.max(1, keepdims=True)
        self.log_p = z - np.log(np.exp(z).sum(1, keepdims=True))

    def _layer(self, name: str, x: np.ndarray, rectify: bool = True) -> np.ndarray:
        self.inputs[name] = x
        z = x @ self.weights[f"{name}.w"].T + self.weights[f"{name}.b"]
        self.positive[name] = z > 0 if rectify else np.ones(z.shape, bool)
        return np.maximum(z, 0) if rectify else z

    def _layers(self, name: str, n: int, x: np.ndarray) -> np.ndarray:
        for k in range(n):
            x = self._layer(f"{name}.{k}", x)
        return x

    def gradients(self, d_log_p: np.ndarray) -> Weights:
        """Gradients of a loss from those of the log-probabilities."""
        grads: Weights = {}

        def layer(name: str, d: np.ndarray) -> np.ndarray:
            d = d * self.positive[name]
            flat, x = d.reshape(-1, d.shape[-1]), self.inputs[name]
            grads[f"{name}.w"], grads[f"{name}.b"] = flat.T @ x.reshape(-1, x.shape[-1]), flat.sum(0)
            return d @ self.weights[f"{name}.w"]

        def layers(name: str, n: int, d: np.ndarray) -> np.ndarray:
            for k in range(n - 1, -1, -1):
                d = layer(f"{name}.{k}", d)
            return d

        levels: dict[int, np.ndarray] = {}
        d = layer("head.0", layer("head.1", d_log_p - np.exp(self.log_p) * d_log_p.sum(1, keepdims=True)))
        for i in range(len(self.shape.back) - 1, -1, -1):
            k = len(self.shape.levels) - 1 - i
            d = layers(f"up{i}", len(self.shape.back[i]), d)
            levels[k] = d[:, : self.split[i]]
            at, w = self.geometry.nearest[k]
            below = np.zeros((len(self.geometry.xyz[k + 1]), d.shape[1] - self.split[i]))
            np.add.at(below, at, d[:, None, self.split[i] :] * w[:, :, None])
            d = below
        for i in range(len(self.shape.levels) - 1, -1, -1):
            if i + 1 < len(self.shape.levels):
                d = d + levels[i + 1]
            fine = np.zeros((len(self.geometry.xyz[i]), self.inputs[f"down{i}.0.0"].shape[-1] - 3))
            start = 0
            for s, (_, n, widths) in enumerate(self.shape.levels[i].scales):
                top = np.zeros((len(d), n, widths[-1]))
                np.put_along_axis(top, self.argmax[f"down{i}.{s}"][:, None, :], d[:, None, start : start + widths[-1]], 1)
                start += widths[-1]
                np.add.at(fine, self.geometry.balls[i][s], layers(f"down{i}.{s}", len(widths), top)[:, :, :-3])
            d = fine
        return grads


def loss(log_p: np.ndarray, y: np.ndarray, class_weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(weighted sum of negative log-probabilities, sum of weights, gradient of the first)."""
    known = (y >= 0) & (y < log_p.shape[1])
    at, row = np.where(known, y, 0), np.arange(len(y))
    w = np.where(known, class_weights[at], 0.0)
    d = np.zeros(log_p.shape)
    d[row, at] = -w
    return float(-(w * log_p[row, at]).sum()), float(w.sum()), d


# --- blocks in tasks -----------------------------------------------------------------------------------

CHANNELS = ("x", "y", "z", "hag", "intensity")


def block_table(points: DataFrame, size: int, by: str = "plot", key: str = "point_id", seed: int = 42, label: str | None = "label") -> DataFrame:
    """(block, n, x array<double>, y array<int>, ids array): a row per sampled block, its channels point by point in id order.

    Coordinates are about the block's centre, over its greatest distance from it."""
    b = sampling.block_normalised(sampling.block(points, size, by, key, seed), by)
    y = F.col(label).cast("int") if label else F.lit(0)
    row = F.struct(F.col(key).alias("id"), "position", F.array(*[F.col(c).cast("double") for c in CHANNELS]).alias("x"), y.alias("y"))
    g = b.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select(F.col(by).cast("string").alias("block"), F.size("r").alias("n"), F.flatten(F.col("r.x")).alias("x"), F.col("r.y").alias("y"), F.col("r.id").alias("ids"))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(block, x (n, channels), y (n,)) of every row."""
    for i in range(batch.num_rows):
        x = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(float)
        y = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
        yield batch.column(0)[i].as_py(), x.reshape(len(y), -1), y


def log_probabilities(blocks: DataFrame, shape: Shape, weights: Weights, seed: int = 42) -> DataFrame:
    """(block, id, log_p array<double>) of every point of ``blocks``; weights go to the tasks, their size is the network's."""
    sent = blocks.sparkSession.sparkContext.broadcast(weights)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (name, x, _) in enumerate(_each(batch)):
                p = Run(shape, sent.value, x, Geometry.of(x, shape, draw_of(seed, name))).log_p
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), batch.column(3)[i].values, lists], names=["block", "id", "log_p"])

    return blocks.select("block", "x", "y", "ids").mapInArrow(run, f"block string, id {kind}, log_p array<double>")


def scorer(shape: Shape, weights: Weights):  # noqa: ANN201
    """The network as the scorer of ``ml.block_inference``: blocks (b, n, channels) to probabilities (b, n, classes)."""
    return lambda blocks: np.stack([np.exp(Run(shape, weights, x, Geometry.of(x, shape)).log_p) for x in blocks.astype(float)])


# --- training ------------------------------------------------------------------------------------------

FIXED, FAN = 2.0**32, 32


@dataclass(frozen=True)
class Training:
    """The settings of training."""

    epochs: int = 100
    batch: int = 16
    rate: float = 0.001
    decay: float = 0.0001
    step: int = 20
    gamma: float = 0.7
    clip: float = 1.0
    seed: int = 42


@dataclass
class State:
    epoch: int
    weights: Weights
    mean: Weights
    square: Weights
    steps: int = 0

    @staticmethod
    def fresh(weights: Weights) -> State:
        return State(0, weights, {n: np.zeros_like(w) for n, w in weights.items()}, {n: np.zeros_like(w) for n, w in weights.items()})


def _flat(arrays: Weights, names: list[str]) -> np.ndarray:
    return np.concatenate([arrays[n].ravel() for n in names])


def _shaped(vector: np.ndarray, like: Weights, names: list[str]) -> Weights:
    ends = np.cumsum([like[n].size for n in names])
    return {n: v.reshape(like[n].shape) for n, v in zip(names, np.split(vector, ends[:-1]), strict=True)}


def gradient(blocks: DataFrame, shape: Shape, weights: Weights, class_weights: np.ndarray, seed: int = 42) -> tuple[Weights, float, np.ndarray]:
    """(gradient of the mean weighted loss, the loss, confusion (class, prediction)) over all ``blocks`` (block, x, y).

    A task returns one row of whole numbers; rows are summed in groups of FAN tasks until one is left."""
    names = sorted(weights)
    sent = blocks.sparkSession.sparkContext.broadcast((weights, class_weights))
    extra = 2 + shape.classes**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            known, of_class = sent.value
            for name, x, y in _each(batch):
                done = Run(shape, known, x, Geometry.of(x, shape, draw_of(seed, name)))
                value, weight, d = loss(done.log_p, y, of_class)
                valid = (y >= 0) & (y < shape.classes)
                cells = np.bincount((y * shape.classes + done.log_p.argmax(1))[valid], minlength=shape.classes**2)
                part = np.concatenate([np.rint(_flat(done.gradients(d), names) * FIXED), np.rint(np.array([value, weight]) * FIXED), cells]).astype(np.int64)
                total = part if total is None else total + part
        if total is not None:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "sum"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["sum"]], 0)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "sum": [total.tobytes()]})

    parts = blocks.select("block", "x", "y").mapInArrow(run, "part long, sum binary")
    left = blocks.rdd.getNumPartitions()
    while left > 1:
        parts = parts.groupBy((F.col("part") / FAN).cast("long").alias("_to")).applyInPandas(add, "part long, sum binary")
        left = -(-left // FAN)
    rows = parts.collect()
    if not rows:
        return {n: np.zeros_like(w) for n, w in weights.items()}, 0.0, np.zeros((shape.classes, shape.classes), np.int64)
    total = np.sum([np.frombuffer(r["sum"], np.int64) for r in rows], 0)
    value, weight = total[-extra] / FIXED, total[-extra + 1] / FIXED
    grads = _shaped(total[: -extra] / FIXED / max(weight, 1e-12), weights, names)
    return grads, value / max(weight, 1e-12), total[-shape.classes**2 :].reshape(shape.classes, shape.classes)


def adam(state: State, grads: Weights, cfg: Training) -> State:
    """One step: clip by the norm of all gradients, add the decay, and move by both moments; the rate falls by gamma every ``step`` epochs."""
    norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    scale = min(1.0, cfg.clip / (norm + 1e-6))
    t, rate = state.steps + 1, cfg.rate * cfg.gamma ** (state.epoch // cfg.step)
    out = State(state.epoch, {}, {}, {}, t)
    for n, w in state.weights.items():
        g = grads[n] * scale + cfg.decay * w
        m, v = 0.9 * state.mean[n] + 0.1 * g, 0.999 * state.square[n] + 0.001 * g * g
        out.mean[n], out.square[n] = m, v
        out.weights[n] = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return out


def mean_overlap(cells: np.ndarray) -> float:
    """Mean of intersection over union of the classes that occur."""
    both, union = np.diag(cells), cells.sum(0) + cells.sum(1) - np.diag(cells)
    return float((both[union > 0] / union[union > 0]).mean()) if (union > 0).any() else 0.0


def store(spark: SparkSession, state: State, scores: dict[str, float], path: str) -> None:
    """An epoch as a table (epoch, steps, scores, name, shape, values, mean, square): a partition that is written whole or not at all."""
    rows = [(state.steps, *map(float, scores.values()), n, list(w.shape), w.ravel().tolist(), state.mean[n].ravel().tolist(), state.square[n].ravel().tolist()) for n, w in sorted(state.weights.items())]
    schema = "steps long, " + ", ".join(f"{n} double" for n in scores) + ", name string, shape array<int>, `values` array<double>, mean array<double>, square array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={state.epoch}")


def stored_epochs(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, train_loss, train_miou, val_loss, val_miou) of the epochs stored so far."""
    return spark.read.parquet(path).select("epoch", "train_loss", "train_miou", "val_loss", "val_miou").distinct().orderBy("epoch")


def restore(spark: SparkSession, path: str, epoch: int) -> State:
    rows = spark.read.parquet(path).where(F.col("epoch") == epoch).collect()
    arrays = lambda c: {r["name"]: np.array(r[c], float).reshape(r["shape"]) for r in rows}
    return State(epoch, arrays("values"), arrays("mean"), arrays("square"), rows[0]["steps"])


def best_weights(spark: SparkSession, path: str) -> tuple[int, Weights]:
    """The epoch of greatest overlap on the validation blocks, the first of equals."""
    top = stored_epochs(spark, path).orderBy(F.desc("val_miou"), "epoch").first()["epoch"]
    return top, restore(spark, path, top).weights


def train(train_blocks: DataFrame, val_blocks: DataFrame, path: str, shape: Shape = Shape(), cfg: Training = Training()) -> DataFrame:  # noqa: B008
    """Train on ``train_blocks`` (block, x, y) and return the stored epochs; goes on from the last one that ``path`` holds.

    An epoch deals all blocks into steps of about ``batch`` by a draw from (seed, epoch, block).  Class weights are balanced over all
    training points; points with another label than a class have weight 0."""
    spark = train_blocks.sparkSession
    blocks = keep(train_blocks.select("block", "x", "y"))
    n = blocks.count()
    counts = {r["y"]: r["n"] for r in blocks.select(F.explode("y").alias("y")).groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.get(c, 0) for c in range(shape.classes))
    class_weights = np.array([total / (shape.classes * counts[c]) if counts.get(c) else 0.0 for c in range(shape.classes)])
    state = State.fresh(fresh(shape, cfg.seed))
    if exists(spark, path):
        state = restore(spark, path, stored_epochs(spark, path).agg(F.max("epoch")).first()[0])
    steps = max(1, n // cfg.batch)
    while state.epoch < cfg.epochs:
        order = F.pmod(F.xxhash64(F.lit(cfg.seed), F.lit(state.epoch), "block"), F.lit(steps))
        value, cells = 0.0, np.zeros((shape.classes, shape.classes), np.int64)
        for k in range(steps):
            grads, part, hit = gradient(blocks.where(order == k), shape, state.weights, class_weights, cfg.seed)
            value, cells = value + part / steps, cells + hit
            state = adam(state, grads, cfg) if hit.sum() else state
        _, val, val_cells = gradient(val_blocks, shape, state.weights, class_weights, cfg.seed)
        state = replace(state, epoch=state.epoch + 1)
        store(spark, state, {"train_loss": value, "train_miou": mean_overlap(cells), "val_loss": val, "val_miou": mean_overlap(val_cells)}, path)
    release(blocks)
    return stored_epochs(spark, path)
