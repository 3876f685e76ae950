"""The point network: forward passes against loops, gradients against differences, training for any dealing of blocks."""

import math

import numpy as np
import pytest

from stemline.operators import ml, network
from stemline.operators.network import Geometry, Level, Run, Shape, State, Training

SMALL = Shape((Level(7, ((0.5, 4, (3, 4)), (1.1, 6, (2, 3)))), Level(3, ((1.0, 3, (4,)), (2.0, 5, (3, 2)))), Level(1, ((4.0, 3, (5,)),))), ((4,), (3, 4), (3,)), head=3)


def cloud(n=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.6, (n, 5))
    x[:, 3:] = rng.random((n, 2))
    return x, (x[:, 2] > 0).astype(int)


def looped(shape, weights, x):
    """Log-probabilities of a block, one point, ball and channel at a time."""

    def dense(name, v, rectify=True):
        out = [sum(w * c for w, c in zip(row, v)) + b for row, b in zip(weights[f"{name}.w"].tolist(), weights[f"{name}.b"].tolist())]
        return [max(0.0, c) for c in out] if rectify else out

    def far(a, b):
        return sum((p - q) ** 2 for p, q in zip(a, b))

    places, features = [[tuple(p[:3]) for p in x.tolist()]], [x.tolist()]
    for i, level in enumerate(shape.levels):
        here, taken = places[-1], [0]
        while len(taken) < min(level.centres, len(here)):
            taken.append(max(range(len(here)), key=lambda k: (min(far(here[k], here[t]) for t in taken), -k)))
        outs = []
        for t in taken:
            row = []
            for s, (radius, n, widths) in enumerate(level.scales):
                inside = [k for k in range(len(here)) if far(here[k], here[t]) <= radius * radius][:n]
                members = []
                for k in inside:
                    v = [*features[-1][k], *[a - b for a, b in zip(here[k], here[t])]]
                    for d in range(len(widths)):
                        v = dense(f"down{i}.{s}.{d}", v)
                    members.append(v)
                row += [max(c) for c in zip(*members)]
            outs.append(row)
        places.append([here[t] for t in taken])
        features.append(outs)
    below = features[-1]
    for u, widths in enumerate(shape.back):
        k = len(shape.levels) - 1 - u
        out = []
        for p, f in zip(places[k], features[k]):
            near = sorted(range(len(places[k + 1])), key=lambda c: (far(p, places[k + 1][c]), c))[:3]
            w = [1 / (far(p, places[k + 1][c]) + 1e-8) for c in near]
            v = [*f, *[sum(a * below[c][j] for a, c in zip(w, near)) / sum(w) for j in range(len(below[0]))]]
            for d in range(len(widths)):
                v = dense(f"up{u}.{d}", v)
            out.append(v)
        below = out
    z = [dense("head.1", dense("head.0", v), False) for v in below]
    return np.array([[c - max(r) - math.log(sum(math.exp(e - max(r)) for e in r)) for c in r] for r in z])


@pytest.mark.parametrize("n", [24, 5, 1])
def test_forward_equals_loops(n):
    x, _ = cloud(n)
    weights = network.fresh(SMALL, 3)
    assert Run(SMALL, weights, x, Geometry.of(x, SMALL)).log_p == pytest.approx(looped(SMALL, weights, x), abs=1e-9)


def test_gradients_equal_differences():
    x, y = cloud()
    of_class = np.array([0.7, 1.6])
    y[3] = -1  # without a class, so without weight
    weights = {n: w + 0.03 * n.endswith(".b") for n, w in network.fresh(SMALL, 4).items()}
    geometry = Geometry.of(x, SMALL)

    def value():
        return network.loss(Run(SMALL, weights, x, geometry).log_p, y, of_class)[0]

    run = Run(SMALL, weights, x, geometry)
    grads = run.gradients(network.loss(run.log_p, y, of_class)[2])
    rng, some = np.random.default_rng(1), 0
    for name, w in weights.items():
        for _ in range(6):
            at = tuple(rng.integers(s) for s in w.shape)
            kept, step = w[at], 1e-6
            w[at] = kept + step
            up = value()
            w[at] = kept - step
            down = value()
            w[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-5)
            some += abs(grads[name][at]) > 1e-6
    assert some > 60


def test_full_shape_has_the_documented_widths():
    sizes = {n: (a, b) for n, a, b in Shape().layers()}
    assert sizes["down0.0.0"] == (8, 16) and sizes["down1.1.2"] == (96, 128) and sizes["down3.1.0"] == (515, 256)
    assert sizes["up0.0"] == (1536, 512) and sizes["up1.0"] == (768, 512) and sizes["up2.0"] == (352, 256) and sizes["up3.0"] == (133, 128) and sizes["head.1"] == (64, 2)
    x, _ = cloud(40)
    got = Run(Shape(), network.fresh(Shape()), x, Geometry.of(x, Shape())).log_p
    assert got.shape == (40, 2) and np.exp(got).sum(1) == pytest.approx(np.ones(40))


def blocks(spark, seeds, n=24):
    rows = [(f"b{s}", *(a.ravel().tolist() for a in cloud(n, s))) for s in seeds]
    return spark.createDataFrame(rows, "block string, x array<double>, y array<int>")


def test_training(spark, tmp_path):
    """The loss falls; any number of partitions and a restart give the same weights; the best epoch is that of the greatest overlap."""
    data, val = blocks(spark, range(12)), blocks(spark, range(50, 54))
    cfg = Training(epochs=6, batch=4, rate=0.05, step=3)
    whole = network.train(data.repartition(7), val, f"{tmp_path}/a", SMALL, cfg).collect()
    assert [r.epoch for r in whole] == [1, 2, 3, 4, 5, 6] and whole[-1].train_loss < 0.8 * whole[0].train_loss
    network.train(data.coalesce(1), val.repartition(3), f"{tmp_path}/b", SMALL, Training(epochs=2, batch=4, rate=0.05, step=3))
    again = network.train(data.coalesce(1), val, f"{tmp_path}/b", SMALL, cfg).collect()
    assert again == whole
    best, weights = network.best_weights(spark, f"{tmp_path}/a")
    assert best == max(whole, key=lambda r: (r.val_miou, -r.epoch)).epoch
    for n, w in network.best_weights(spark, f"{tmp_path}/b")[1].items():
        assert (w == weights[n]).all()
    table = network.to_table(spark, weights)
    assert all((w == weights[n]).all() for n, w in network.from_table(table).items())


def test_one_step_equals_the_formula(spark):
    data = blocks(spark, range(5))
    weights, of_class = network.fresh(SMALL, 2), np.array([1.0, 1.0])
    grads, value, cells = network.gradient(data.repartition(40), SMALL, weights, of_class, 1)
    runs = [(Run(SMALL, weights, x, Geometry.of(x, SMALL, network.draw_of(1, f"b{s}"))), y) for s in range(5) for x, y in [cloud(24, s)]]
    assert value == pytest.approx(np.mean([-r.log_p[np.arange(24), y].mean() for r, y in runs])) and cells.sum() == 120
    want = sum(r.gradients(network.loss(r.log_p, y, of_class)[2])["down0.1.0.w"] for r, y in runs) / 120
    assert grads["down0.1.0.w"] == pytest.approx(want, abs=1e-8)
    state = network.adam(State.fresh(weights), grads, Training(clip=1e9, decay=0.0, rate=0.01))
    moved = weights["head.1.b"] - state.weights["head.1.b"]
    assert moved == pytest.approx(0.01 * np.sign(grads["head.1.b"]), abs=1e-5)
    assert network.gradient(data.limit(0), SMALL, weights, of_class)[2].sum() == 0


def test_blocks_and_scorer(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(f"p{i % 3}", i, *map(float, rng.random(5)), i % 2) for i in range(200)], "plot string, point_id long, x double, y double, z double, hag double, intensity double, label int")
    rows = network.block_table(p, 80).collect()
    assert {(r.block, r.n, len(r.x), len(r.y), len(r.ids)) for r in rows} == {(f"p{i}", 80, 400, 80, 80) for i in range(3)}
    weights = network.fresh(SMALL, 1)
    out = network.log_probabilities(network.block_table(p, 40), SMALL, weights)
    assert out.count() == 120
    whole, _ = ml.block_inference(p, network.scorer(SMALL, weights), 2, 1.0, ml.Blocks(points=40))
    got = whole.toPandas()
    assert len(got) == 200 and (got["p0"] + got["p1"]).to_numpy() == pytest.approx(np.ones(200), abs=1e-6)
