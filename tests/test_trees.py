"""Forests: tables of nodes against growth one row and split at a time."""

import numpy as np
import pytest

from stemline.functions.draws import draw_of
from stemline.operators import trees

NAMES = ("a", "b", "c", "d")


def rows(n, seed=0, levels=12):
    rng = np.random.default_rng(seed)
    x = np.round(rng.integers(0, levels, (n, 4)) / 7, 6)
    x[:, 3] = 1.0  # never varies
    y = ((x[:, 0] + 0.3 * x[:, 1] + rng.normal(0, 0.15, n)) > 1.0).astype(int)
    return [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]


def brute(data, n_trees, features, seed, weights, max_depth=None, bootstrap=True):
    """{(tree, path): (feature, split, n0, n1)} with every split of every candidate tried."""
    out = {}

    def grow(tree, path, members):
        n = [sum(k for r, k in members if r[5] == c) * weights[c] for c in (0, 1)]
        out[tree, path] = (None, None, *n)
        vary = [i for i in range(4) if len({r[1 + i] for r, _ in members}) > 1]
        vary = sorted(sorted(vary, key=lambda i: draw_of(seed, tree, path, NAMES[i]))[:features]) if features < 4 else vary
        if 0 in n or (max_depth is not None and len(path) >= max_depth):
            return
        best = []
        for i in vary:
            values = sorted({r[1 + i] for r, _ in members})
            for v, after in zip(values, values[1:]):
                cost = 0
                for side in (True, False):
                    c = [sum(k for r, k in members if r[5] == q and (r[1 + i] <= v) == side) * weights[q] for q in (0, 1)]
                    cost += sum(c) - sum(q * q for q in c) / sum(c)
                best.append((round(cost, 9), i, v, (v + after) / 2))
        if best:
            _, i, v, split = min(best)
            out[tree, path] = (NAMES[i], split, *n)
            grow(tree, path + "L", [m for m in members if m[0][1 + i] <= v])
            grow(tree, path + "R", [m for m in members if m[0][1 + i] > v])

    for t in range(n_trees):
        times = lambda r, t=t: sum(draw_of(seed, t, r[0]) >= c for c in trees.POISSON) if bootstrap else 1
        grow(t, "", [(r, times(r)) for r in data if times(r)])
    return out


@pytest.mark.parametrize(("few", "features", "depth", "bootstrap"), [(0, 4, None, False), (0, 2, None, True), (30, 2, None, True), (10_000, 2, 3, True), (0, 1, 2, True)])
def test_forest_equals_brute_force(spark, few, features, depth, bootstrap):
    data = rows(90)
    df = spark.createDataFrame(data, "point_id long, a double, b double, c double, d double, label int").repartition(4)
    n1 = sum(r[5] for r in data)
    want = brute(data, 2, features, 7, (len(data) / (2 * (len(data) - n1)), len(data) / (2 * n1)), depth, bootstrap)
    nodes = trees.train(df, NAMES, 2, features, 7, depth, bootstrap, few=few).collect()
    assert len(nodes) == len(want)
    for r in nodes:
        feature, split, c0, c1 = want[r.tree, r.node]
        assert (r.feature, r.n0, r.n1) == (feature, pytest.approx(c0), pytest.approx(c1)) and r.split == (split if split is None else pytest.approx(split))
        assert r.gain >= -1e-9 and (r.gain > 1e-12 or feature is None or features < 4)


def test_forest_predicts_and_is_stored(spark, tmp_path):
    schema = "point_id long, a double, b double, c double, d double, label int"
    df = spark.createDataFrame(rows(400, 1), schema)
    nodes = trees.train(df, NAMES, 8, seed=3)
    trees.save(nodes, f"{tmp_path}/m")
    kept = trees.load(spark, f"{tmp_path}/m")
    key = lambda d: sorted((r.tree, r.node, r.feature or "", r.split or 0, r.n, r.gain) for r in d.collect())
    assert key(kept) == key(nodes)
    test = spark.createDataFrame(rows(200, 2) + [(900, None, 1.0, 1.0, 1.0, 1)], schema)
    whole, parts = (trees.predict(kept, test, NAMES, ("point_id",), most).orderBy("point_id").collect() for most in (2_000_000, 40))
    assert [(r.point_id, r.semantic_pred, pytest.approx(r.p1)) for r in whole] == [(r.point_id, r.semantic_pred, r.p1) for r in parts]
    right = {r[0]: r[5] for r in rows(200, 2)}
    assert np.mean([right[r.point_id] == r.semantic_pred for r in whole if r.point_id < 200]) > 0.85
    found = trees.importances(kept).collect()
    assert found[0].feature == "a" and sum(r.importance for r in found) == pytest.approx(1) and "d" not in {r.feature for r in found}


def test_forests_of_edge_cases(spark):
    schema = "point_id long, a double, b double, c double, d double, label int"
    one = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1), (2, None, 1.0, 1.0, 1.0, 0), (3, 1.0, 2.0, 1.0, 1.0, None), (4, 1.0, 2.0, 1.0, 1.0, -1)], schema)
    for few in (0, 100):
        assert [(r.node, r.feature, r.n1) for r in trees.train(one, NAMES, 1, bootstrap=False, balanced=False, few=few).collect()] == [("", None, 1.0)]
        assert trees.train(one.limit(0), NAMES, 3, few=few).count() == 0
    # equal rows of both classes can't be told apart
    same = spark.createDataFrame([(i, 1.0, 2.0, 3.0, 4.0, i % 2) for i in range(6)], schema)
    assert [(r.feature, r.n0, r.n1) for r in trees.train(same, NAMES, 1, bootstrap=False, balanced=False, few=0).collect()] == [(None, 3.0, 3.0)]
    # deeper than a whole number's bits
    chain = spark.createDataFrame([(i, float(2**i) if i < 300 else 0.0, 0.0, 0.0, 0.0, i % 2) for i in range(90)], schema)
    deep = trees.train(chain, NAMES, 1, 4, bootstrap=False, balanced=False)
    assert deep.selectExpr("max(length(node))").first()[0] > 30
