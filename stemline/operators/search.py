"""Exact nearest vectors: cells round pivots, bounds by the triangle inequality, and blocks of pairs.

Every vector belongs to its nearest pivot.  A query first searches its own cell; its k-th distance there bounds the search,
and of the other cells it visits only those that may hold a nearer vector, for no vector of a cell is nearer than
the query's distance from the pivot less the cell's greatest radius, or the least radius less that distance.  Cells and their visitors are
dealt into blocks of bounded size, so a cell with many rows or many visitors is many tasks, and a task holds
one block of each.  Nothing that grows is sent to every task: pivots are a stated number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.draws import draw
from stemline.sources.shared import keep, release

PIVOTS, BLOCK = 64, 4096
#: Bounds are loosened by this share, beyond any rounding of distances.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, v) with ``cell``, the nearest pivot, and ``r``, the distance from it."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                d = _distances(_matrix(part.column(1)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d.min(1)))], names=["id", "v", "cell", "r"])

    return rows.mapInArrow(run, f"id {kind}, v array<double>, cell int, r double")


def _visits(queries: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(id, v, cell) of the cells beside its own that a query (id, v, cell, bound) must visit; ``low`` and ``high`` are the cells' radii."""
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                d = np.sqrt(_distances(_matrix(part.column(1)), pivots))
                least = np.maximum(0, np.maximum(d - high, low - d))
                bound = np.sqrt(part.column(3).to_numpy())
                go = least * (1 - SLACK) <= bound[:, None] * (1 + SLACK)
                go &= np.isfinite(high)[None, :]
                go[np.arange(len(d)), part.column(2).to_numpy()] = False
                row, cell = np.nonzero(go)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return queries.select("id", "v", "cell", "bound").mapInArrow(run, f"id {kind}, v array<double>, cell int")


def _searched(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(q, other, d2) of each query's k nearest in a block, for every query (id, v, cell) and block of its cell."""
    per = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = per(queries, "nq").join(per(base, "nb"), "cell")
    blocks = lambda n: F.sequence(F.lit(0).cast("long"), (F.col(n) - 1).cast("long"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    a = queries.join(sizes, "cell").select("cell", own("nq").alias("i"), F.explode(blocks("nb")).alias("j"), "id", "v")
    b = base.join(sizes, "cell").select("cell", F.explode(blocks("nq")).alias("i"), own("nb").alias("j"), "id", "v")
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, base)]

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        q, other = left["id"].to_numpy(), right["id"].to_numpy()
        found = []
        y = np.stack(right["v"].to_list()) if len(right) else None
        for s in range(0, len(left) if len(right) else 0, 256):
            d = _distances(np.stack(left["v"].iloc[s : s + 256].to_list()), y)
            d[q[s : s + 256, None] == other[None, :]] = np.inf
            at = np.argsort(d, 1, kind="stable")[:, :k]
            best = np.take_along_axis(d, at, 1)
            row, col = np.nonzero(np.isfinite(best))
            found.append(pd.DataFrame({"q": q[s + row], "other": other[at[row, col]], "d2": best[row, col]}))
        return pd.concat(found) if found else pd.DataFrame({"q": q[:0], "other": other[:0], "d2": np.zeros(0)})

    return a.groupBy("cell", "i", "j").cogroup(b.groupBy("cell", "i", "j")).applyInPandas(one, f"q {kinds[0]}, other {kinds[1]}, d2 double")


def vector_knn(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", by: str | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(q, other, d2, rank): the k vectors of ``base`` of least squared distance from each of ``queries``, other ids than its own; ties go to the lower id.

    With ``by`` only vectors of the same group are searched, and groups are the cells.  Vectors that are null, of another length than the
    first pivot or have a null or non-finite component are not searched; keys are distinct and not null."""
    value = F.transform(vec, lambda x: x.cast("double"))
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = lambda df: df.where(finite & (F.size(vec) > 0)).select(F.col(key).alias("id"), value.alias("v"), *([F.struct(F.col(by), F.size(vec)).alias("cell")] if by else []))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d2", "other"))).where(F.col("rank") <= k)
    if by:
        return ranked(_searched(rows(queries), rows(base), k))
    whole = rows(base)
    chosen = whole.orderBy(draw(42, "id"), "id").limit(pivots).collect()
    width = len(chosen[0]["v"]) if chosen else 0
    at = np.array([r["v"] for r in chosen if len(r["v"]) == width], float)
    if not chosen:
        return ranked(_searched(rows(queries).withColumn("cell", F.lit(0)), whole.withColumn("cell", F.lit(0)), k))
    same = F.size("v") == width
    b, q = (keep(_celled(df.where(same), at)) for df in (whole, rows(queries)))
    # one row per pivot
    radii = {r["cell"]: r for r in b.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    low = np.array([radii[c]["lo"] if c in radii else np.inf for c in range(len(at))])
    high = np.array([radii[c]["hi"] if c in radii else -np.inf for c in range(len(at))])
    first = keep(ranked(_searched(q, b, k)))
    bound = first.groupBy("q").agg(F.count("*").alias("n"), F.max("d2").alias("d")).select(F.col("q").alias("id"), F.when(F.col("n") == k, F.col("d")).alias("d"))
    open_ = q.join(bound, "id", "left").select("id", "v", "cell", F.coalesce("d", F.lit(float("inf"))).alias("bound"))
    visits = keep(_visits(open_, at, low, high))
    found = keep(ranked(first.select("q", "other", "d2").unionByName(_searched(visits, b, k))))
    release(b, q, first, visits)
    return found
