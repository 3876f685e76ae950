"""Registered queries of the point network, with a SQL form of a network of two levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.operators import labels, network, sampling
from stemline.operators.network import Level, Shape, Training
from stemline.plans.projections import points
from stemline.plans.registry import RP, draw_sql, query
from stemline.sources.shared import folder

#: A network narrow enough to be written out: two levels of two scales each, with layers of different depth.
TWO = Shape((Level(8, ((0.24, 5, (3, 2)), (0.6, 9, (2,)))), Level(3, ((0.8, 4, (3,)), (1.8, 6, (2, 2))))), ((4,), (3, 2)), head=3)
WEIGHTS = {n: np.round(w + (0.05 if n.endswith(".b") else 0.0), 3) for n, w in network.fresh(TWO, 5).items()}
SIZE = 200


def _dense(name: str, inputs: list[str], rectify: bool = True) -> list[str]:
    w, b = WEIGHTS[f"{name}.w"], WEIGHTS[f"{name}.b"]
    sums = [" + ".join([f"({float(v)!r}) * {x}" for v, x in zip(row, inputs, strict=True)]) for row in w]
    return [f"GREATEST(0, {s} + ({float(c)!r}))" if rectify else f"{s} + ({float(c)!r})" for s, c in zip(sums, b, strict=True)]


def _stack(source: str, keys: str, prefix: str, n: int, inputs: list[str], last: str = "") -> tuple[str, list[str]]:
    """Nested selects of n layers over ``source``, and the names of what they give; ``last`` wraps the last layer's outputs."""
    names = inputs
    for k in range(n):
        outs = _dense(f"{prefix}.{k}", names)
        names = [f"h{k}_{i}" for i in range(len(outs))]
        wrapped = [f"{last}({o})" if k == n - 1 and last else o for o in outs]
        source = f"(SELECT {keys}, {', '.join(f'{o} AS {c}' for o, c in zip(wrapped, names, strict=True))} FROM {source} _{k}{f' GROUP BY {keys}' if k == n - 1 and last else ''})"
    return source, names


def _away(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz")


def _level_sql(k: int, level: Level, width: int) -> tuple[list[str], int]:
    """CTEs from level l{k} (plot, i, n, x, y, z, c0...) to l{k + 1}: centres f{k}, a table per scale, and both side by side."""
    square = "(q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y) + (q.z - b.z) * (q.z - b.z)"
    out = [
        f"""f{k}(plot, r, taken) AS (SELECT plot, 0, [{{'i': i, 'x': x, 'y': y, 'z': z}}] FROM l{k} WHERE i = FLOOR({draw_sql(42, "plot")} * n) UNION ALL
  SELECT plot, r + 1, LIST_APPEND(taken, m) FROM (SELECT f.plot, f.r, f.taken, ARG_MAX({{'i': b.i, 'x': b.x, 'y': b.y, 'z': b.z}}, {{'d': LIST_MIN(LIST_TRANSFORM(taken, lambda q: {square})), 'o': -b.i}}) AS m
    FROM f{k} f JOIN l{k} b ON b.plot = f.plot WHERE f.r + 1 < LEAST({level.centres}, b.n) GROUP BY f.plot, f.r, f.taken))""",
        f"t{k} AS MATERIALIZED (SELECT plot, r - 1 AS i, taken[r].x AS x, taken[r].y AS y, taken[r].z AS z FROM (SELECT plot, taken, UNNEST(RANGE(1, LEN(taken) + 1)) AS r FROM f{k} QUALIFY r > 0 AND LEN(taken) = MAX(LEN(taken)) OVER (PARTITION BY plot)))",
    ]
    columns, joins = [], []
    for s, (radius, members, widths) in enumerate(level.scales):
        near = f"(SELECT c.plot, c.i, {', '.join(f'p.c{j} AS g{j}' for j in range(width))}, p.x - c.x AS gx, p.y - c.y AS gy, p.z - c.z AS gz FROM t{k} c JOIN l{k} p ON p.plot = c.plot AND {_away('c', 'p')} <= {radius!r} * {radius!r} QUALIFY ROW_NUMBER() OVER (PARTITION BY c.plot, c.i ORDER BY p.i) <= {members})"
        body, names = _stack(near, "plot, i", f"down{k}.{s}", len(widths), [*[f"g{j}" for j in range(width)], "gx", "gy", "gz"], "MAX")
        out.append(f"s{k}_{s} AS MATERIALIZED (SELECT * FROM {body} e)")
        joins.append(f"JOIN s{k}_{s} ON s{k}_{s}.plot = t.plot AND s{k}_{s}.i = t.i")
        columns += [f"s{k}_{s}.{n}" for n in names]
    out.append(f"l{k + 1} AS MATERIALIZED (SELECT t.plot, t.i, COUNT(*) OVER (PARTITION BY t.plot) AS n, t.x, t.y, t.z, {', '.join(f'{c} AS c{j}' for j, c in enumerate(columns))} FROM t{k} t {' '.join(joins)})")
    return out, len(columns)


def network_sql(shape: Shape = TWO, size: int = SIZE) -> str:
    parts = [
        f"bk AS MATERIALIZED (SELECT plot, point_id, x / 50 AS x, y / 50 AS y, z / 50 AS z, z / 500 AS h FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY plot ORDER BY {draw_sql(42, 'plot', 'point_id')}, point_id) <= {size})",
        "l0 AS MATERIALIZED (SELECT plot, point_id, ROW_NUMBER() OVER (PARTITION BY plot ORDER BY point_id) - 1 AS i, COUNT(*) OVER (PARTITION BY plot) AS n, x, y, z, x AS c0, y AS c1, z AS c2, h AS c3, 0.5e0 AS c4 FROM bk)",
    ]
    widths = [shape.inputs]
    for k, level in enumerate(shape.levels):
        more, width = _level_sql(k, level, widths[-1])
        parts += more
        widths.append(width)
    below, coarse = f"l{len(shape.levels)}", widths[-1]
    for u, layers in enumerate(shape.back):
        k = len(shape.levels) - 1 - u
        near = f"(SELECT p.plot, p.i, {', '.join(f'p.c{j} AS k{j}' for j in range(widths[k]))}, 1 / ({_away('p', 'c')} + 1e-8) AS w, {', '.join(f'c.c{j} AS v{j}' for j in range(coarse))} FROM l{k} p JOIN {below} c ON c.plot = p.plot QUALIFY ROW_NUMBER() OVER (PARTITION BY p.plot, p.i ORDER BY {_away('p', 'c')}, c.i) <= 3)"
        mean = f"(SELECT plot, i, {', '.join(f'ANY_VALUE(k{j}) AS k{j}' for j in range(widths[k]))}, {', '.join(f'SUM(w * v{j}) / SUM(w) AS v{j}' for j in range(coarse))} FROM {near} e GROUP BY plot, i)"
        body, names = _stack(mean, "plot, i", f"up{u}", len(layers), [*[f"k{j}" for j in range(widths[k])], *[f"v{j}" for j in range(coarse)]])
        parts.append(f"u{u} AS MATERIALIZED (SELECT l.plot, l.i, l.x, l.y, l.z, {', '.join(f'e.{c} AS c{j}' for j, c in enumerate(names))} FROM {body} e JOIN l{k} l ON l.plot = e.plot AND l.i = e.i)")
        below, coarse = f"u{u}", layers[-1]
    hidden = _dense("head.0", [f"c{j}" for j in range(coarse)])
    last = _dense("head.1", [f"h{j}" for j in range(len(hidden))], False)
    parts.append(f"z AS (SELECT plot, i, {last[0]} AS z0, {last[1]} AS z1 FROM (SELECT plot, i, {', '.join(f'{o} AS h{j}' for j, o in enumerate(hidden))} FROM {below}))")
    return f"{RP}, {', '.join(parts)} SELECT z.plot, l0.point_id, ROUND(z0 - GREATEST(z0, z1) - LN(EXP(z0 - GREATEST(z0, z1)) + EXP(z1 - GREATEST(z0, z1))), 5) + 0.0 AS p0, ROUND(z1 - GREATEST(z0, z1) - LN(EXP(z0 - GREATEST(z0, z1)) + EXP(z1 - GREATEST(z0, z1))), 5) + 0.0 AS p1 FROM z JOIN l0 ON l0.plot = z.plot AND l0.i = z.i"


def _channels(p: DataFrame) -> DataFrame:
    return p.select("plot", "point_id", *[(F.col(c) / 50).alias(c) for c in "xyz"], (F.col("z") / 500).alias("hag"), F.lit(0.5).alias("intensity"), labels.binary_label().alias("label"))


@query(network_sql())
def network_scores(spark: SparkSession, d: str) -> DataFrame:
    """Log-probabilities of a sampled block of every plot: two levels down and up again."""
    p = _channels(sampling.cap_per_class(points(spark, d), SIZE, ("plot",)))
    row = F.struct("point_id", F.array(*network.CHANNELS).alias("x"))
    blocks = p.groupBy(F.col("plot").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("r")).select("block", F.flatten("r.x").alias("x"), F.transform("r", lambda _: F.lit(0)).alias("y"), F.col("r.point_id").alias("ids"))
    got = network.log_probabilities(blocks, TWO, WEIGHTS)
    return got.select(F.col("block").alias("plot"), F.col("id").alias("point_id"), *[(F.round(F.col("log_p")[k], 5) + 0.0).alias(f"p{k}") for k in (0, 1)])


@query()
def network_training(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs on a block of every zone of every plot, one plot in five for validation, and the epochs' losses and overlaps."""
    p = _channels(points(spark, d))
    zones = network.block_table(p.withColumn("zone", F.concat_ws("#", "plot", F.floor(F.col("x") / 2))), 32, "zone")
    val = F.crc32(F.encode("block", "UTF-8")) % 5 == 0
    return network.train(zones.where(~val), zones.where(val), f"{folder(spark)}/epochs-{spark.sparkContext.applicationId}-{id(zones)}", TWO, Training(epochs=2, batch=64, rate=0.01))
