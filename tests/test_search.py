"""Exact vector search over cells and blocks against all pairs."""

import numpy as np
import pytest

from stemline.operators import search


def brute(queries, base, k):
    out = []
    for q, x in queries:
        near = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), i) for i, y in base if i != q)[:k]
        out += [(q, i, round(d, 9), r) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def rows(df):
    return sorted((r.q, r.other, round(r.d2, 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("n", "k", "pivots", "block"), [(300, 5, 12, 16), (300, 3, 1, 4096), (40, 60, 7, 5), (5, 2, 64, 2)])
def test_search_equals_all_pairs(spark, monkeypatch, n, k, pivots, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(n)
    base = [(i, np.round(rng.normal(i % 6 * 3, 1, 8), 2).tolist()) for i in range(n)]
    base += [(1000 + i, base[3][1]) for i in range(n // 3)]  # a third are copies of one
    df = spark.createDataFrame(base, "vec_id long, embedding array<double>").repartition(3)
    assert rows(search.vector_knn(df.where("vec_id % 4 = 0"), df, k, pivots=pivots)) == brute([b for b in base if b[0] % 4 == 0], base, k)


def test_far_cells_are_not_visited(spark):
    rng = np.random.default_rng(3)
    pivots = np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 100.0]])
    q = spark.createDataFrame([(i, rng.normal(0, 1, 2).tolist(), 0, 4.0) for i in range(20)], "id long, v array<double>, cell int, bound double")
    assert search._visits(q, pivots, np.array([0.0, 0.0, 0.0]), np.array([5.0, 5.0, 5.0])).count() == 0
    assert search._visits(q, pivots, np.array([0.0, 0.0, np.inf]), np.array([5.0, 99.0, -np.inf])).select("cell").distinct().collect() == [(1,)]


def test_search_of_odd_vectors(spark):
    base = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [4.0, 6.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame([(*b, b[0] % 2) for b in base], "vec_id int, embedding array<double>, side int")
    two = [(i, v) for i, v in base if i in (1, 7, 8)]
    got = rows(search.vector_knn(df, df, 9, pivots=1))
    assert got in (brute(two, two, 9), [])
    assert rows(search.vector_knn(df, df, 9, by="side")) == sorted(brute([two[0]], two[:2], 9) + brute([two[1]], two[:2], 9))
    assert search.vector_knn(df.limit(0), df, 2).count() == 0 and search.vector_knn(df, df.limit(0), 2).count() == 0


def test_verticality_in_expressions_equals_the_vectors(spark):
    from stemline.operators import features

    rng = np.random.default_rng(5)
    shapes = [rng.normal(0, rng.uniform(0.05, 2, 3), (9, 3)) @ np.linalg.qr(rng.normal(0, 1, (3, 3)))[0] for _ in range(60)] + [np.zeros((5, 3)), np.outer(np.arange(6), [1.0, 2.0, 3.0])]
    covs = [np.cov(s.T, bias=True) for s in shapes]
    df = spark.createDataFrame([(i, *map(float, (c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2]))) for i, c in enumerate(covs)], "id long, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")
    for r in features.verticality(features.eigenvalues(df)).collect():
        values, vectors = np.linalg.eigh(covs[r.id])
        assert (r.l3, r.l2, r.l1) == pytest.approx(tuple(values), abs=1e-6)
        assert r.verticality == (pytest.approx(1 - abs(vectors[2, 0]), abs=1e-6) if r.id < 60 else 0.0)
