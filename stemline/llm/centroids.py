"""Centroid clustering of integer vectors by partial-distance search.

Vectors of exactly 64 finite components become whole numbers floor(1024 x) once, in a stored table.  A
round reads that table, assigns every vector to its nearest centroid and returns, for each task, one row of sums per
centroid; the few centroids are all that the driver ever holds.

The search in a task adds squared differences of the components of most variance first.  All centroids
get the first few components; the one that is ahead is finished and is the bound.  The others go on in steps and are
left as soon as their sum is strictly above the best so far; those that last finish all 64
components.  Distances are whole numbers, so the order of components changes the work and never the result.

Defined results: vectors that are null, have another number of components or a null or non-finite one
are left out; repeated rows count as often as they occur; ties go to the smaller number; start
centroids with equal hashes (a repeated vec_id) are ordered by their components; a null vec_id is assigned but starts no centroid;
with fewer than eight vectors there are as many centroids as vectors; without any the result is empty.  A component
of 2**17 or more in absolute value raises an error, for its squared distances do not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemline.llm.scratch import cut, drop

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, STEP, LIMIT = 64, 1024, 8, 10, 8, 2.0**17


def whole(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector is not one of ``dimensions`` finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    each = F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) >= LIMIT, F.raise_error(F.lit("a component of 2**17 or more: its squared distances do not fit a long"))).otherwise(F.floor(x.cast("double") * scale)).cast("long"))
    return F.when((F.size(vector) == dimensions) & finite, each)


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number."""
    head = ((x[:, None, :step] - centroids[None, :, :step]) ** 2).sum(2)
    best_of = head.argmin(1)
    best = head[np.arange(len(x)), best_of] + ((x[:, step:] - centroids[best_of, step:]) ** 2).sum(1)
    ahead = best_of.copy()
    for k, c in enumerate(centroids):
        alive = np.flatnonzero((ahead != k) & (head[:, k] <= best))
        part = head[alive, k]
        for a in range(step, x.shape[1], step):
            if not len(alive):
                break
            part = part + ((x[alive, a : a + step] - c[a : a + step]) ** 2).sum(1)
            on = part <= best[alive]
            alive, part = alive[on], part[on]
        won = (part < best[alive]) | ((part == best[alive]) & (k < best_of[alive]))
        best[alive[won]], best_of[alive[won]] = part[won], k
    return best_of, best


def _matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)[:, order]


def _blocks(batch: pa.RecordBatch, size: int = 16_384) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, size):
        yield batch.slice(a, size)


def variance_order(vectors: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Components by falling variance over all vectors: one row of sums a task, one row in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dimensions))
        n = 0
        for batch in batches:
            for part in _blocks(batch):
                x = _matrix(part.column(0), np.arange(dimensions)).astype(np.float64)
                total += [x.sum(0), (x * x).sum(0)]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], **{f"s{i}": [v] for i, v in enumerate(total.ravel())}})

    names = [f"s{i}" for i in range(2 * dimensions)]
    row = vectors.select("e").mapInArrow(run, "n long, " + ", ".join(f"{c} double" for c in names)).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    if not row["n"]:
        return np.arange(dimensions)
    sums = np.array(row[1:]).reshape(2, dimensions)
    return np.argsort(-(sums[1] / row["n"] - (sums[0] / row["n"]) ** 2), kind="stable")


def _sums(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple]:
    """{cluster: (vectors, summed distance, sum of each component)}, exact: one row a task and cluster is shuffled."""
    k, width = centroids.shape
    shuffled = centroids[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, width), np.int64)
        for batch in batches:
            for part in _blocks(batch):
                x = _matrix(part.column(0), order)
                found, distance = nearest(x, shuffled)
                for j in range(k):
                    here = found == j
                    n[j] += here.sum()
                    total[j, order] += x[here].sum(0)
                    inertia[j] += sum(distance[here].tolist())
        at = np.flatnonzero(n)
        if len(at):
            inertias = pa.array([str(inertia[j]) for j in at], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), inertias, *[pa.array(total[at, i]) for i in range(width)]], names=["c", "n", "d", *[f"s{i}" for i in range(width)]])

    names = [f"s{i}" for i in range(width)]
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = vectors.select("e").mapInArrow(run, "c int, n long, d string, " + ", ".join(f"{c} long" for c in names)).groupBy("c").agg(*[exact(c) for c in ("n", "d", *names)]).collect()
    return {r["c"]: (int(r["n"]), int(r["d"]), [int(r[c]) for c in names]) for r in rows}


def start(vectors: DataFrame, centroids: int = CENTROIDS, seed: int = 3) -> np.ndarray:
    """The vectors with the least hashes of their ids, in the order of the hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256)
    rows = vectors.where(F.col("_key").isNotNull()).select(hashed.alias("h"), "e").orderBy("h", "e").limit(centroids).collect()
    return np.array([r["e"] for r in rows], np.int64)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector."""
    kind = vectors.schema[key].dataType.simpleString()
    table = cut(vectors.select(F.col(key).alias("_key"), whole(F.col(vector), dimensions, scale).alias("e")).where("e IS NOT NULL"))
    at = start(table, centroids, seed)
    if not len(at):
        empty = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        drop(table)
        return vectors.sparkSession.createDataFrame([], empty)
    order = variance_order(table, dimensions)
    for _ in range(rounds):
        for c, (n, _, total) in _sums(table, at, order).items():
            at[c] = [s // n for s in total]
    inertia = {c: d for c, (_, d, _) in _sums(table, at, order).items()}
    each = np.array([inertia.get(c, 0) for c in range(len(at))], object)
    if sum(each) >= 1 << 63:
        raise OverflowError("the summed distances do not fit a long")
    named = pa.array([hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in at.tolist()])
    each, every, shuffled = each.astype(np.int64), int(sum(each)), at[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                found, distance = nearest(_matrix(part.column(1), order), shuffled)
                cols = [part.column(0), pa.array(found.astype(np.int32)), pa.array(distance), pa.array(each[found]), pa.array(np.full(len(found), every)), named.take(pa.array(found))]
                yield pa.RecordBatch.from_arrays(cols, names=["_key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(run, f"_key {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").withColumnRenamed("_key", key)
