"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash
is the closest of the 2 * d signed axes.  ``hashes`` such hashes make the key of a table's
bucket, and ``tables`` tables are kept.  Each vector is stored in its own bucket and probes
besides it the buckets in which one hash is the second closest axis.  Candidate pairs are
verified by cosine in double precision.

Both numbers follow from the input (``plan``): as many hashes as keep the unlike vectors that
a vector meets by chance at a few, whatever the number of vectors, so candidates grow with
the links and not with the square of the table; and as many tables as miss a pair at the
threshold, the hardest, with probability 1e-8, by the miss rate of simulated pairs of that length.

Equal vectors of one label form one class with a count, so copies never meet in pairs;
links are counted between classes and weighted by their sizes.

Nothing that grows with the input passes through the driver: joins are by sorting, since tables of
numbers are small enough on disk to be broadcast long before they are in memory, and the simulated
pairs are made in blocks whatever the vectors' length.

Defined results: a null label, a null, empty or zero vector, and one with null or non-finite
components link with nothing; vectors of different lengths never link; repeated keys are
separate rows; rows with a null key link like others, and a component's id is the least key that
is not null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm.components import components
from stemline.llm.scratch import cut, drop
from stemline.llm.textvec import mix

SEED, MISSED, TRIALS, BLOCK = 77, 1e-8, 2000, 1 << 19


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x


def axes(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(closest, second closest) signed axis of each row after the rotation; axis i is 2 * i, its negative 2 * i + 1."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    rows = np.arange(len(x))
    best = size.argmax(1)
    sign = lambda i: (x[rows, i] < 0).astype(np.int64) + 2 * i
    if x.shape[1] < 2:
        return sign(best), sign(best)
    size[rows, best] = -1
    return sign(best), sign(size.argmax(1))


def keys(x: np.ndarray, tables: int, hashes: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(own key (n, tables), probed keys (n, tables, hashes)) of unit rows."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, d, hashes])
    own, probes = np.zeros((len(x), tables), np.uint64), np.zeros((len(x), tables, hashes), np.uint64)
    for t in range(tables):
        found = [axes(padded, rng.choice([-1.0, 1.0], (3, d))) for _ in range(hashes)]

        def code(second: int, t=t, found=found) -> np.ndarray:
            total = np.full(len(x), t + 1, np.uint64)
            for h, pair in enumerate(found):
                total = mix(total ^ (pair[int(h == second)].astype(np.uint64) + np.uint64(h << 40)))
            return total

        own[:, t] = code(-1)
        for h in range(hashes):
            probes[:, t, h] = code(h)
    return own, probes


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, of a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def miss_rate(d: int, hashes: int, least: float) -> float:
    """How often a pair of cosine ``least`` meets in no bucket of one table, in simulated pairs; never under 0.02."""
    rng = np.random.default_rng([SEED, d, hashes])
    hits, per = [], max(1, BLOCK // d)
    for i in range(0, TRIALS, per):
        x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, min(per, TRIALS - i), d)))
        z -= (z * x).sum(1, keepdims=True) * x
        y = least * x + math.sqrt(max(0.0, 1 - least**2)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        (a, pa), (b, pb) = (keys(v, 2, hashes) for v in (x, y))
        hits.append((a == b) | (pa == b[:, :, None]).any(2) | (pb == a[:, :, None]).any(2))
    hit = np.concatenate(hits)
    return max(0.02, 1 - float(hit.mean()) + 2 * float(hit.std()) / math.sqrt(hit.size))


def plan(n: int, d: int, least: float, missed: float = MISSED) -> tuple[int, int]:
    """(tables, hashes) for n vectors of one label and length d."""
    for hashes in range(1, 17):
        tables = math.ceil(math.log(missed) / math.log(miss_rate(d, hashes, least)))
        width = 1 << max(0, (d - 1).bit_length())
        if 4 * n * tables * (1 + 2 * hashes) <= (2 * width) ** hashes or d < 2:
            break
    return tables, hashes


def _hash(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    """(id, code, probe boolean) of classes (id, label, vec, size); codes of unlike labels or lengths differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for d in np.unique(lengths):
                whole = batch.filter(pa.array(lengths == d))
                for a in range(0, len(whole), per := max(1, min(2048, BLOCK // int(d)))):
                    part = whole.slice(a, per)
                    x = matrix(part.column(1))
                    x = x / np.abs(x).max(1, keepdims=True)
                    own, probes = keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes)
                    n, each = len(part), tables * (1 + hashes)
                    group = mix(np.asarray(part.column(2)).astype(np.int64).view(np.uint64) + np.uint64(d))
                    code = mix(np.concatenate([own, probes.reshape(n, -1)], 1) ^ group[:, None]).view(np.int64).ravel()
                    at = pa.array(np.repeat(np.arange(n), each))
                    probe = np.tile(np.arange(each) >= tables, n)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(code), pa.array(probe)], names=["id", "code", "probe"])

    return classes.select("id", "vec", F.xxhash64("label")).mapInArrow(run, "id long, code long, probe boolean")


def candidates(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    """(a, b), a < b: the pairs of classes that meet in a bucket, each once."""
    hashed = cut(_hash(classes, tables, hashes))
    own = hashed.where(~F.col("probe")).select(F.col("id").alias("x"), "code")
    pairs = own.join(hashed.withColumnRenamed("id", "y").hint("merge"), "code").where(F.when(F.col("probe"), F.col("x") != F.col("y")).otherwise(F.col("x") < F.col("y")))
    found = cut(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    drop(hashed)
    return found


def _verify(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    side = lambda x: classes.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"), F.col("vec").alias(f"v{x}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("la") == F.col("lb")) & (F.size("va") == F.size("vb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x, y = matrix(part.column(2)), matrix(part.column(3))
                cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(cosine >= least))

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def cluster(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", least: float = 0.98, tables: int | None = None, hashes: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; ``tables`` and ``hashes`` follow from the input where they are not given."""
    wide = F.transform(vec, lambda v: v.cast("double"))
    sound = F.col(label).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.when(sound, wide).alias("vec"))
    grouped = rows.where(F.col("vec").isNotNull()).groupBy("label", "vec").agg(F.min("key").alias("least"), F.count("*").alias("size"))
    # a class has a number of its own, for keys may be null or repeated; numbers hold only for what is written
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    if tables is None or hashes is None:
        most = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).agg(F.max("n"), F.max("d")).first()
        tables, hashes = plan(most[0] or 1, most[1] or 1, least)
    pairs = candidates(classes, tables, hashes)
    links = cut(_verify(pairs, classes, least))
    roots = components(links)

    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = ways.join(classes.select(F.col("id").alias("b"), "size").hint("merge"), "b").groupBy("a").agg(F.sum("size").alias("beyond"))
    rooted = (
        classes.join(beyond.hint("merge"), classes["id"] == beyond["a"], "left")
        .join(roots.hint("merge"), "id", "left")
        .select("label", "vec", (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    )
    # written, so that the join can split a large component's rows among tasks
    firsts = cut(classes.select("id", "least").join(roots.hint("merge"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("least").alias("component")))
    named = rooted.join(firsts.hint("merge"), "root").select("label", "vec", "n_links", "component")
    component = F.coalesce("component", "key")
    return rows.join(named.hint("merge"), ["label", "vec"], "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept")
    )
