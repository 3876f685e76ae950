"""Decision trees with exact splits and no limit of depth, and forests of them, as tables of nodes.

A tree grows level by level, all nodes of a level at once.  Rows carry their tree and node; for each of a node's candidate
features the rows are added up by value and class, and running sums along the values, in parts that are ranges of values, give every split its impurity.
The least weighted Gini impurity wins, ties go to the earlier feature and the lower value; the
threshold is the midpoint to the next value.  A node with at most ``few`` rows is grown to its leaves by one kernel call, by the same rule.

A node considers the first ``features`` of its features that vary, in the order of draws from (seed, tree, node, feature); a
row's bootstrap count in a tree is a draw from the Poisson distribution of mean 1, from (seed, tree, key).  Counts are whole numbers
until class weights multiply them, so nothing depends on an order of addition.

A model is a table (tree, node, feature, split, n, n0, n1, gain): ``node`` is the path of L and R from the root, a leaf has no feature.  Rows with a
null label or a null value of any feature are not learnt from; a value that is null at prediction goes right, as one that is greater than all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.functions.draws import draw, draw_of
from stemline.sources.shared import keep, release

#: The cumulative Poisson distribution of mean 1, as far as draws of 52 bits tell.
POISSON = tuple(float(x) for x in np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)])))
BUCKETS = 64
NODE_SCHEMA = "tree int, node string, feature string, split double, n double, n0 double, n1 double, gain double"


def copies(trees: int, seed: int, key: str, bootstrap: bool):  # noqa: ANN201
    """array<struct<tree, k>>: how often each tree takes a row."""
    each = F.sequence(F.lit(0), F.lit(trees - 1))
    count = lambda t: reduce(lambda s, c: s + (draw(seed, t, key) >= c).cast("int"), POISSON, F.lit(0)) if bootstrap else F.lit(1)
    return F.filter(F.transform(each, lambda t: F.struct(t.cast("int").alias("tree"), count(t).alias("k"))), lambda x: x["k"] > 0)


def impurity(c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Gini impurity times weight: n - (c0**2 + c1**2) / n."""
    n = c0 + c1
    return np.where(n > 0, n - (c0 * c0 + c1 * c1) / np.where(n > 0, n, 1), 0.0)


def grown(x: np.ndarray, y: np.ndarray, k: np.ndarray, names: list[str], weights: tuple[float, float], tree: int, node: str, features: int, seed: int, max_depth: int | None) -> list[tuple]:
    """Node rows of the subtree under ``node``."""
    out, stack = [], [(node, np.arange(len(y)))]
    while stack:
        path, at = stack.pop()
        c0, c1 = (float(k[at][y[at] == c].sum()) * weights[c] for c in (0, 1))
        leaf = (tree, path, None, None, c0 + c1, c0, c1, 0.0)
        vary = [i for i in range(len(names)) if x[at, i].min() < x[at, i].max()]
        if features < len(names):
            vary = sorted(sorted(vary, key=lambda i: (draw_of(seed, tree, path, names[i]), i))[:features])  # ties go to the earlier feature
        if c0 == 0 or c1 == 0 or not vary or (max_depth is not None and len(path) >= max_depth):
            out.append(leaf)
            continue
        best = None
        for i in vary:
            order = at[np.argsort(x[at, i], kind="stable")]
            v = x[order, i]
            totals = [np.cumsum(np.where(y[order] == c, k[order], 0)) for c in (0, 1)]
            left = [t * w for t, w in zip(totals, weights, strict=True)]
            right = [(t[-1] - t) * w for t, w in zip(totals, weights, strict=True)]
            cost = impurity(*left) + impurity(*right)
            cost[np.append(v[1:] == v[:-1], True)] = np.inf
            b = int(cost.argmin())
            if best is None or cost[b] < best[0]:
                best = (float(cost[b]), i, float((v[b] + v[b + 1]) / 2), v[b])
        cost, i, split, value = best
        out.append((tree, path, names[i], split, c0 + c1, c0, c1, float(impurity(np.array(c0), np.array(c1))) - cost))
        goes = x[at, i] <= value
        stack += [(path + "L", at[goes]), (path + "R", at[~goes])]
    return out


def _kernel(rows: DataFrame, names: list[str], weights: tuple[float, float], features: int, seed: int, max_depth: int | None) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_list()).astype(float)
        found = grown(x, pdf["y"].to_numpy(), pdf["k"].to_numpy(np.int64), names, weights, int(pdf["tree"].iloc[0]), pdf["node"].iloc[0], features, seed, max_depth)
        return pd.DataFrame(found, columns=["tree", "node", "feature", "split", "n", "n0", "n1", "gain"]).astype({"tree": "int32", "split": "float64"})

    return rows.select("tree", "node", "x", "y", "k").groupBy("tree", "node").applyInPandas(one, NODE_SCHEMA)


def _candidates(nodes: DataFrame, names: list[str], features: int, seed: int) -> DataFrame:
    """(tree, node, i): the features that a node considers, of those that vary in it (``lo`` and ``hi`` arrays)."""
    vary = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.col("lo")[i] < F.col("hi")[i])
    if features < len(names):
        named = F.array(*[F.lit(n) for n in names])
        ranked = F.array_sort(F.transform(vary, lambda i: F.struct(draw(seed, "tree", "node", named[i]).alias("d"), i.alias("i"))))
        vary = F.transform(F.slice(ranked, 1, features), lambda s: s["i"])
    return nodes.select("tree", "node", F.explode(vary).alias("i"))


def _splits(rows: DataFrame, candidates: DataFrame, cuts: list[list[float]], weights: tuple[float, float]) -> DataFrame:
    """(tree, node, i, cost, split, value): the best split of each node."""
    # a feature's values are dealt into ranges by cuts of the whole sample, so that a root's rows are summed in many tasks
    edges = F.array(*[F.array(*[F.lit(c) for c in cs]) if cs else F.array().cast("array<double>") for cs in cuts])
    wide = rows.join(candidates, ["tree", "node"]).select("tree", "node", "i", F.col("x")[F.col("i")].alias("v"), "y", "k")
    counted = wide.groupBy("tree", "node", "i", "v").agg(*[F.sum(F.when(F.col("y") == c, F.col("k")).otherwise(0)).alias(f"k{c}") for c in (0, 1)])
    dealt = counted.withColumn("b", F.size(F.filter(edges[F.col("i")], lambda c: c < F.col("v"))))
    part = ["tree", "node", "i"]
    ahead = W.partitionBy(*part).orderBy("b")
    sums = dealt.groupBy(*part, "b").agg(F.sum("k0").alias("s0"), F.sum("k1").alias("s1"), F.min("v").alias("first"))
    whole = W.partitionBy(*part)
    sums = sums.select(*part, "b", *[(F.sum(f"s{c}").over(ahead) - F.col(f"s{c}")).alias(f"p{c}") for c in (0, 1)], *[F.sum(f"s{c}").over(whole).alias(f"t{c}") for c in (0, 1)], F.lead("first").over(ahead).alias("beyond"))
    here = W.partitionBy(*part, "b").orderBy("v")
    run = dealt.select(*part, "b", "v", *[F.sum(f"k{c}").over(here).alias(f"r{c}") for c in (0, 1)], F.lead("v").over(here).alias("next")).join(sums, [*part, "b"])
    left = [(F.col(f"p{c}") + F.col(f"r{c}")) * F.lit(weights[c]) for c in (0, 1)]
    right = [(F.col(f"t{c}") - F.col(f"p{c}") - F.col(f"r{c}")) * F.lit(weights[c]) for c in (0, 1)]
    gini = lambda a, b: (a + b) - (a * a + b * b) / (a + b)
    after = F.coalesce("next", "beyond")
    cost = run.where(after.isNotNull()).select(*part, "v", after.alias("after"), (gini(*left) + gini(*right)).alias("cost"))
    best = cost.groupBy("tree", "node").agg(F.min(F.struct("cost", "i", "v", "after")).alias("s"))
    return best.select("tree", "node", "s.i", "s.cost", ((F.col("s.v") + F.col("s.after")) / 2).alias("split"), F.col("s.v").alias("value"))


def train(rows: DataFrame, names: tuple[str, ...], trees: int = 200, features: int | None = None, seed: int = 42, max_depth: int | None = None, bootstrap: bool = True, balanced: bool = True, key: str = "point_id", label: str = "label", few: int = 20_000) -> DataFrame:
    """The node table of a forest on rows (key, label in {0, 1}, names); ``features`` is the root of their number unless given.

    ``key`` may name one column; rows are told apart by it only in their draws."""
    features, columns = features or max(1, int(len(names) ** 0.5)), list(names)
    known = rows.where(F.col(label).isin(0, 1) & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    base = keep(known.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("int").alias("y")))
    counts = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weights = tuple(total / (2 * counts[c]) if balanced and counts.get(c) else 1.0 for c in (0, 1))
    cuts = [sorted(set(c)) for c in base.select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(columns))]).approxQuantile([f"x{i}" for i in range(len(columns))], [j / BUCKETS for j in range(1, BUCKETS)], 0.01)]
    live = keep(base.select("x", "y", F.explode(copies(trees, seed, "id", bootstrap)).alias("c")).select("c.tree", F.lit("").alias("node"), "x", "y", "c.k"))
    done = []
    while True:
        summary = live.groupBy("tree", "node").agg(F.count("*").alias("rows"), *[F.sum(F.when(F.col("y") == c, F.col("k")).otherwise(0)).alias(f"k{c}") for c in (0, 1)], F.array(*[F.min(F.col("x")[i]) for i in range(len(columns))]).alias("lo"), F.array(*[F.max(F.col("x")[i]) for i in range(len(columns))]).alias("hi"))
        summary = keep(summary)
        if summary.isEmpty():
            break
        small = F.col("rows") <= few
        done.append(keep(_kernel(live.join(summary.where(small).select("tree", "node"), ["tree", "node"], "left_semi"), columns, weights, features, seed, max_depth)))
        large = summary.where(~small)
        n0, n1 = (F.col(f"k{c}") * F.lit(weights[c]) for c in (0, 1))
        deep = F.lit(max_depth is not None) & (F.length("node") >= F.lit(max_depth or 0))
        able = large.where((F.col("k0") > 0) & (F.col("k1") > 0) & ~deep)
        best = keep(_splits(live, _candidates(able, columns, features, seed), cuts, weights))
        named = F.get(F.array(*[F.lit(c) for c in columns]), F.col("i"))
        here = large.join(best, ["tree", "node"], "left").select("tree", "node", named.alias("feature"), "split", (n0 + n1).alias("n"), n0.alias("n0"), n1.alias("n1"), F.when(F.col("i").isNotNull(), (n0 + n1) - (n0 * n0 + n1 * n1) / (n0 + n1) - F.col("cost")).otherwise(0.0).alias("gain"))
        done.append(keep(here))
        goes = F.when(F.col("x")[F.col("i")] <= F.col("value"), "L").otherwise("R")
        parted = keep(live.join(best.select("tree", "node", "i", "value"), ["tree", "node"]).select("tree", F.concat("node", goes).alias("node"), "x", "y", "k"))
        release(live, summary, best)
        live = parted
    release(live, base)
    return reduce(DataFrame.unionByName, done) if done else rows.sparkSession.createDataFrame([], NODE_SCHEMA)


def arrays(nodes: list[tuple], names: list[str]) -> tuple[np.ndarray, ...]:
    """(first node of each tree, feature or -1, split, left, right, probability of class 1) of node rows."""
    ordered = sorted(nodes, key=lambda r: (r[0], len(r[1]), r[1]))
    at = {(r[0], r[1]): i for i, r in enumerate(ordered)}
    roots = np.array([i for i, r in enumerate(ordered) if not r[1]])
    feature = np.array([names.index(r[2]) if r[2] is not None else -1 for r in ordered])
    split = np.array([r[3] if r[3] is not None else np.nan for r in ordered])
    child = [np.array([at.get((r[0], r[1] + s), 0) for r in ordered]) for s in "LR"]
    return roots, feature, split, *child, np.array([r[6] / r[4] if r[4] else 0.0 for r in ordered])


def walked(model: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the probability of class 1, all rows a level at a time."""
    roots, feature, split, left, right, p = model
    total = np.zeros(len(x))
    for root in roots:
        at, on = np.full(len(x), root), np.arange(len(x))
        while len(on := on[feature[at[on]] >= 0]):
            here = at[on]
            at[on] = np.where(x[on, feature[here]] <= split[here], left[here], right[here])
        total += p[at]
    return total


def predict(nodes: DataFrame, rows: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ("plot", "point_id"), most: int = 2_000_000) -> DataFrame:
    """(keys, semantic_pred, p0, p1): means over the trees of their leaves' shares; class 1 where p1 is greater.

    Trees go to the tasks in parts of at most ``most`` nodes, each part one pass that adds its sum; a larger tree is a part of its own."""
    spark, columns = rows.sparkSession, list(names)
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect()
    parts: list[list[int]] = []
    for r in sizes:
        if parts and sum(s["n"] for s in sizes if s["tree"] in parts[-1]) + r["n"] <= most:
            parts[-1].append(r["tree"])
        else:
            parts.append([r["tree"]])
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    out = rows.select(*keys, x.alias("_x"), F.lit(0.0).alias("_p"))
    schema = out.schema
    for k, part in enumerate(parts):
        model = arrays([tuple(r) for r in nodes.where(F.col("tree").isin(part)).select("tree", "node", "feature", "split", "n", "n0", "n1").collect()], columns)
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                v = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                p = batch.column(len(keys) + 1).to_numpy() + walked(sent.value, v)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
        out = keep(out) if k + 1 < len(parts) else out
    p1 = F.col("_p") / F.lit(max(len(sizes), 1))
    return out.select(*keys, (p1 > 0.5).cast("int").alias("semantic_pred"), (1 - p1).alias("p0"), p1.alias("p1"))


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): gains over each tree's total gain, averaged over the trees that split at all, the greatest first."""
    each = nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    share = each.withColumn("g", F.col("g") / F.sum("g").over(W.partitionBy("tree")))
    n = share.select(F.count_distinct("tree").alias("_n"))
    # one row
    return share.groupBy("feature").agg(F.sum("g").alias("g")).join(F.broadcast(n)).select("feature", (F.col("g") / F.col("_n")).alias("importance")).orderBy(F.desc("importance"), "feature")


def save(nodes: DataFrame, path: str) -> None:
    """A partition per tree, in order of the paths."""
    nodes.repartition("tree").sortWithinPartitions("tree", "node").write.mode("overwrite").partitionBy("tree").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).parquet(path)
