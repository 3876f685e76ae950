"""Near-duplicate documents by MinHash bands, odd sketches and full verification.

1. Every document becomes its set of distinct word shingles (64-bit hashes), ``bands * rows``
   MinHash samples of it, and an odd sketch: each sample flips one bit of a bitmap, so the
   population count of two bitmaps' XOR estimates how many samples differ.
2. Documents with equal sets form one class; classes meet in the bands.
3. A bucket links its members to its least member, not to each other.  A pair passes if
   its sizes allow the similarity and its odd sketches don't rule it out, and is a link once
   the full sets confirm it.  First each class is tried with the partner that shares most
   bands with it, then with its other buckets' leaders where still apart.
4. A bucket that after this still spans several components is compared across components, all
   of it, by longer odd sketches of its members before their sets: links are lost only where no band collides, which for the threshold itself has the
   probability (1 - threshold**rows)**bands, 2e-5 by default, and vanishes above it.

Defined results: null or empty texts, and texts without words, have empty sets and link with
nothing; fewer words than a shingle are one shingle; equal texts share a component, and
of repeated rows each is reported (a key names one text); rows with a null key link with nothing
but equal texts; an empty table gives no rows.  ``deduplicate`` numbers rows instead: it keeps one row
of a component whatever the keys are, and other columns pass untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm import textvec
from stemline.llm.components import components
from stemline.llm.scratch import cut, drop

WIDTH, BANDS, ROWS, BITS = 5, 40, 5, 512
#: Samples and bits of the sketches that are made only of what large buckets leave apart.
FINE, FINE_BITS = 4096, 8192


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, n, np.uint32), rng.integers(0, 2**32, n, np.uint32) | np.uint32(1)


def samples(found: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n MinHash samples (32 bits) of each non-empty set; ``at`` has where sets begin, and the end."""
    flips, factors = _seeds(n)
    short = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    out = np.empty((n, len(at) - 1), np.uint32)
    work = np.empty_like(short)
    for k in range(n):
        np.bitwise_xor(short, flips[k], out=work)
        np.multiply(work, factors[k], out=work)
        np.bitwise_xor(work, work >> np.uint32(15), out=work)
        np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
        out[k] = np.minimum.reduceat(work, at[:-1])
    return out


def odd_sketch(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps, (documents, bits / 64) words: sample k with value v flips the bit hash(k, v)."""
    n, docs = mins.shape
    slot = textvec.mix(mins.astype(np.uint64) + (np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(bits)
    parity = np.zeros((docs, bits), np.uint8)
    np.bitwise_xor.at(parity, (np.broadcast_to(np.arange(docs), (n, docs)), slot.astype(np.int64)), 1)
    return np.packbits(parity, axis=1).view("<u8")


def estimate(xor_bits: float, n_samples: int, bits: int = BITS) -> float:
    """Similarity that the number of differing bits stands for."""
    return 1 + bits / (4 * n_samples) * math.log(max(1 - 2 * xor_bits / bits, 1e-9))


def most_bits(threshold: float, n_samples: int, bits: int = BITS, deviations: float = 6) -> int:
    """The most differing bits that a pair at the threshold shows, but once in hundreds of millions.

    The deviation is that of the number of differing samples and that of where they fall."""
    d = n_samples * (1 - threshold)
    mean, slope = bits / 2 * (1 - math.exp(-4 * d / bits)), 2 * math.exp(-4 * d / bits)
    variance = slope**2 * n_samples * threshold * (1 - threshold) + bits / 4 * (1 - math.exp(-8 * d / bits))
    return min(bits, math.ceil(mean + deviations * math.sqrt(variance)))


def _fold(found: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit fingerprint per set, of sorted distinct hashes."""
    with np.errstate(over="ignore"):
        mixed = textvec.mix(found ^ np.uint64(seed))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        return textvec.mix(total[at[1:]] - total[at[:-1]])


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, fp array<long> of 2, bands array<long>, odd array<long>); the arrays of empty sets are null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textvec.blocks(batch.column(1)):
                found, at = textvec.shingle_sets(data, offsets, width)
                size = np.diff(at)
                full = np.flatnonzero(size)
                starts = np.append(at[:-1][full], at[-1])
                if len(full):
                    mins = samples(found, starts, bands * rows)
                    odd = odd_sketch(mins)
                    key_ = np.zeros((bands, len(full)), np.uint64)
                    for r in range(rows):
                        key_ = textvec.mix(key_ ^ mins[r::rows].astype(np.uint64)) + np.uint64(r)
                    prints = np.stack([_fold(found, starts, 0x51ED27), _fold(found, starts, 0xA24BAED4963EE407)], 1)
                else:
                    odd, key_, prints = np.zeros((0, BITS // 64), np.uint64), np.zeros((bands, 0), np.uint64), np.zeros((0, 2), np.uint64)

                def lists(values: np.ndarray, full=full, n=b - a) -> pa.Array:
                    which = np.full(n, -1)
                    which[full] = np.arange(len(full))
                    made = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(values).view(np.int64).ravel()), values.shape[1]).cast(pa.list_(pa.int64()))
                    return made.take(pa.array(which, mask=which < 0))

                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), lists(prints), lists(key_.T), lists(odd)], names=["id", "n_shingles", "fp", "bands", "odd"])

    schema = f"id {kind}, n_shingles long, fp array<long>, bands array<long>, odd array<long>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set binary) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textvec.blocks(batch.column(1)):
                found, at = textvec.shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([found[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "set"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, set binary")


def _fine(sets: DataFrame) -> DataFrame:
    """(id, fine array<long>): long odd sketches of (id, set), which tell similarities apart to some hundredths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 128):
                part = batch.slice(a, 128)
                data, offsets = textvec.raw(part.column(1))
                found = np.frombuffer(data.tobytes(), np.uint64)
                odd = odd_sketch(samples(found, offsets // 8, FINE), FINE_BITS)
                ends = pa.array(np.arange(len(part) + 1) * odd.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(odd.view(np.int64).ravel()))], names=["id", "fine"])

    return sets.mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, fine array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                same = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; a component's id is its least key."""
    sketched = cut(sketch(docs, key, text, width, bands, rows))
    nonempty = sketched.where("n_shingles > 0")
    classes = cut(nonempty.groupBy("fp").agg(F.min("id").alias("rep")))
    reps = cut(nonempty.join(classes, (nonempty["fp"] == classes["fp"]) & (nonempty["id"] == classes["rep"])).select("id", "n_shingles", "bands", "odd").dropDuplicates(["id"]))

    members = reps.select("id", F.posexplode("bands").alias("band", "code"))
    hot = members.groupBy("band", "code").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    buckets = cut(members.join(hot.drop("n"), ["band", "code"]))
    pairs = buckets.where("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))

    limit, n = most_bits(percent / 100, bands * rows), BITS // 64
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("odd").alias(f"o{x}"))
    apart = sum((F.bit_count(F.col("oa")[w].bitwiseXOR(F.col("ob")[w])) for w in range(n)), F.lit(0))
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (apart <= limit)

    def passed(some: DataFrame) -> DataFrame:
        return some.join(side("b"), "b").join(side("a"), "a").where(fits).drop("na", "nb", "oa", "ob")

    pairs = cut(passed(pairs))
    wanted = buckets.select("id").distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    sets = cut(_sets(texts, width).dropDuplicates(["id"]))

    best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = cut(_confirm(best, sets, percent))
    roots = components(links)

    def across(some: DataFrame, roots: DataFrame) -> DataFrame:
        to = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
        return some.join(to("a"), "a", "left").join(to("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        """``roots`` after more links: components of the roots that they join."""
        to = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
        up = cut(components(links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
        over = up.select(F.col("id").alias("root"), F.col("root").alias("r"))
        return cut(roots.join(over, "root", "left").select("id", F.coalesce("r", "root").alias("root")).unionByName(up))

    roots = merged(roots, cut(_confirm(across(pairs.select("a", "b"), roots), sets, percent)))

    def apart_in_buckets(roots: DataFrame) -> DataFrame:
        """(band, code, id, root) of the buckets that span several components."""
        rooted = buckets.join(roots, "id", "left").select("band", "code", "id", F.coalesce("root", "id").alias("root"))
        split = rooted.groupBy("band", "code").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "code")
        return cut(rooted.join(split, ["band", "code"]))

    rest = apart_in_buckets(roots)
    fine = cut(_fine(sets.join(rest.select("id").distinct(), "id", "left_semi")))
    rest = cut(rest.join(reps.select("id", "n_shingles", "bands", "odd"), "id").join(fine, "id"))
    one = lambda x: rest.select("band", "code", F.col("id").alias(x), F.col("root").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("odd").alias(f"o{x}"), F.col("fine").alias(f"f{x}"), F.col("bands").alias(f"c{x}"))
    finely = sum((F.bit_count(F.col("fa")[w].bitwiseXOR(F.col("fb")[w])) for w in range(FINE_BITS // 64)), F.lit(0)) <= most_bits(percent / 100, FINE, FINE_BITS)
    # a pair is made in the first band that it shares, not in all
    first = F.array_position(F.zip_with("ca", "cb", lambda p, q: p == q), True) - 1 == F.col("band")
    left = one("a").join(one("b"), ["band", "code"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits & finely & first).select("a", "b").distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = merged(roots, cut(_confirm(cut(left.join(tried, ["a", "b"], "left_anti")), sets, percent)))
    drop(reps, buckets, pairs, sets, fine, rest)

    full = sketched.select(F.col("id"), "n_shingles", "fp").join(classes, "fp", "left").drop("fp")
    named = full.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    component = F.coalesce("root", "rep", "id")
    return named.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row of each component of ``docs``: that of the least key, null keys last, and of rows that share it one.

    Rows are numbered, so that rows of one key or of none are rows like others."""
    row, taken = "_row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    # numbers hold only for what is written
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = cluster(numbered, row, text, percent).select(row, "component_id")
    keyed = found.join(numbered.select(row, F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(row).alias("r")).alias("o")), row)
    kept = keyed.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.r").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
