"""The grid search of neighbourhoods against all pairs, for any number of pairs held at a time."""

import numpy as np
import pytest

from stemline.operators import neighbors


@pytest.mark.parametrize("pairs", [7, 100, 1 << 21])
def test_grid_neighbours_equal_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(neighbors, "PAIRS", pairs)
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n, k = rng.integers(1, 200), int(rng.integers(0, 9))
        x = rng.integers(0, 12, (n, 3)).astype(float) if seed % 2 else rng.normal(size=(n, 3)) * 3
        queries = np.sort(rng.choice(n, rng.integers(0, n + 1), replace=False))
        ids, _, within = neighbors.grid_neighbours(x, queries, 2.0, k)
        for i, q in enumerate(queries):
            d = np.sqrt(((x[q] - x) ** 2).sum(1))
            near = [j for j in np.lexsort((np.arange(n), d)) if d[j] <= 2.0]
            assert within[i] == len(near)
            assert ids[i].tolist() == (near[:k] + [-1] * k)[:k]
