"""Minimum spanning forests of voxel graphs, rooted at markers.

Occupied voxels that share a face are linked.  Faces have a total order: first the greater of the
lesser densities, then of the greater ones, then the lower ids.  Every voxel gets the marker that it is connected with
in the spanning forest of least faces in which no tree has two markers.

The forest is found by Boruvka's rounds: each part without a marker takes its first face to another part, and parts
that took each other's or a common one become one; parts with markers take none, so two of them never merge.
A first pass contracts square tiles, in which a part stops where its first face leaves the tile.
What is left, parts and the faces between them, is a table far smaller than the voxels, which relational rounds halve at least.
No task sees more than a tile, and no box is laid round a plot.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.sources.shared import keep, release

#: A voxel's id is its three indices in 21 bits each, so ids are in (vi, vj, vk) order.
BITS = 21
SHIFTS = (1 << 2 * BITS, 1 << BITS, 1)


def voxel_id(vi: str = "vi", vj: str = "vj", vk: str = "vk"):  # noqa: ANN201
    far = F.greatest(vi, vj, vk) >= (1 << BITS) - 1
    packed = F.col(vi).cast("long") * SHIFTS[0] + F.col(vj).cast("long") * SHIFTS[1] + F.col(vk)
    return F.when(far, F.raise_error(F.lit(f"a voxel index of {1 << BITS} or more")).cast("long")).otherwise(packed)


def contract(a: np.ndarray, b: np.ndarray, order: np.ndarray, marked: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part of each node, faces that still join different parts) after all merges that can be decided here.

    ``a`` and ``b`` are the ends of the faces, ``order`` sorts these; a part is named by one of its nodes, the marked one where it has one."""
    a, b, faces = a[order], b[order], order
    part = np.arange(len(marked))
    fixed = marked | foreign
    while True:
        pa, pb = part[a], part[b]
        on = (pa != pb) & ~(marked[pa] & marked[pb]) & ~(foreign[pa] & foreign[pb])
        a, b, faces, pa, pb = a[on], b[on], faces[on], pa[on], pb[on]
        best = np.full(len(part), len(a))
        np.minimum.at(best, pa, np.arange(len(a)))
        np.minimum.at(best, pb, np.arange(len(a)))
        mine = np.flatnonzero((best < len(a)) & ~fixed)
        first = best[mine]
        other = np.where(pa[first] == mine, pb[first], pa[first])
        inside = ~foreign[other]
        mine, other = mine[inside], other[inside]
        if not len(mine):
            return part, faces
        up = np.arange(len(part))
        up[mine] = other
        both = (up[up] == np.arange(len(part))) & (np.arange(len(part)) < up)
        up[both] = np.flatnonzero(both)
        while (up != up[up]).any():
            up = up[up]
        part = up[part]


def _tile_parts(voxels: DataFrame, by: str, tile: int) -> DataFrame:
    """Rows of two kinds: (id, part) of each voxel, and (id, other, lo, hi, part, part_other) of each undecided face; part_other is null across tiles.

    A part is the id of one of its voxels, or minus its marker."""
    kind = voxels.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, id long, other long, lo double, hi double, part long, part_other long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby([by, "_ti", "_tj"], sort=False).ngroup().to_numpy()
        order = np.lexsort((pdf["id"].to_numpy(), group))
        pdf, group = pdf.iloc[order], group[order]
        ids, density, own = pdf["id"].to_numpy(np.int64), pdf["d"].to_numpy(float), pdf["own"].to_numpy(bool)
        marker, names = pdf["marker"].fillna(0).to_numpy(np.int64), pdf[by].to_numpy()
        # the voxels of all tiles of this part, tile by tile, in one order
        every, index = np.unique(ids, return_inverse=True)
        code = group * len(every) + index
        ends = []
        for step in SHIFTS:
            near = np.minimum(np.searchsorted(every, ids + step), len(every) - 1)
            sought = group * len(every) + near
            at = np.minimum(np.searchsorted(code, sought), len(code) - 1)
            ok = (every[near] == ids + step) & (code[at] == sought)
            ends.append((np.flatnonzero(ok), at[ok]))
        a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        some = own[a] | own[b]
        a, b = a[some], b[some]
        lo, hi = np.minimum(density[a], density[b]), np.maximum(density[a], density[b])
        order = np.lexsort((np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), -hi, -lo))
        part, left = contract(a, b, order, own & (marker > 0), ~own)
        named = np.where(marker[part] > 0, -marker[part], ids[part])
        a, b = a[left], b[left]
        a, b = np.where(own[a], a, b), np.where(own[a], b, a)
        # a face between tiles is handed on by the tile of its lower voxel
        on = own[b] | (ids[a] < ids[b])
        a, b = a[on], b[on]
        edges = pd.DataFrame({by: names[a], "id": ids[a], "other": ids[b], "lo": np.minimum(density[a], density[b]), "hi": np.maximum(density[a], density[b]), "part": named[a], "part_other": pd.array(np.where(own[b], named[b], 0), "Int64")})
        edges.loc[~own[b], "part_other"] = pd.NA
        out = pd.concat([pd.DataFrame({by: names[own], "id": ids[own], "part": named[own]}), edges], ignore_index=True)
        return out[[by, "id", "other", "lo", "hi", "part", "part_other"]].astype({"other": "Int64", "part_other": "Int64"})

    reach = lambda c: F.array_distinct(F.transform(F.array(*[F.lit(o) for o in (-1, 0, 1)]), lambda o: F.floor((F.col(c) + o) / tile)))
    spread = voxels.withColumn("_ti", F.explode(reach("vi"))).withColumn("_tj", F.explode(reach("vj")))
    own = (F.floor(F.col("vi") / tile) == F.col("_ti")) & (F.floor(F.col("vj") / tile) == F.col("_tj"))
    return dealt(spread.select(by, "_ti", "_tj", "id", "d", "marker", own.alias("own")), by, voxels.count()).applyInPandas(one, schema)


def dealt(tiles: DataFrame, by: str, rows: int, most: int = 1 << 16):  # noqa: ANN201
    """``tiles`` (by, _ti, _tj, ...) grouped so that small tiles share a kernel call: about ``most`` rows each, whole tiles by hash."""
    part = F.pmod(F.xxhash64(by, "_ti", "_tj"), F.lit(rows // most + 1))
    return tiles.groupBy(part.alias("_part"))


def _finished(edges: DataFrame, by: str) -> DataFrame:
    """(by, c, p): the last part of every part without a marker, from few enough faces for one kernel call."""
    kind = edges.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(by, sort=False).ngroup().to_numpy()
        ends = np.concatenate([np.stack([group, pdf[c].to_numpy(np.int64)], 1) for c in ("a", "b")])
        nodes, index = np.unique(ends, axis=0, return_inverse=True)
        a, b = np.split(index.ravel(), 2)
        order = np.lexsort(tuple(pdf[c].to_numpy() for c in ("v", "u", "hi", "lo")))
        part, _ = contract(a, b, order, nodes[:, 1] < 0, np.zeros(len(nodes), bool))
        names = pdf[by].to_numpy()[np.unique(group, return_index=True)[1]]
        moved = np.flatnonzero(part != np.arange(len(nodes)))
        return pd.DataFrame({by: names[nodes[moved, 0]], "c": nodes[moved, 1], "p": nodes[part[moved], 1]})

    return edges.select(by, "a", "b", "face.lo", "face.hi", "face.u", "face.v").groupBy(F.lit(0).alias("_all")).applyInPandas(one, f"`{by}` {kind}, c long, p long")


def _shortened(up: DataFrame, by: str) -> DataFrame:
    """Pointers (by, c, p) led to the ends of their chains."""
    while True:
        to = up.select(by, F.col("c").alias("p"), F.col("p").alias("q"))
        moved = keep(up.join(to, [by, "p"], "left").select(by, "c", F.coalesce("q", "p").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
        release(up)
        up = moved.select(by, "c", "p")
        if moved.where("moved").isEmpty():
            return up


def spanning_labels(voxels: DataFrame, by: str = "plot", tile: int = 64, few: int = 1 << 16) -> DataFrame:
    """(by, vi, vj, vk, label) of occupied voxels (by, vi, vj, vk, d, marker or null): the marker of each voxel's tree, 0 where none is connected.

    At most one marker a voxel, numbered from 1 within ``by``.  Once no more than ``few`` faces are left, one kernel call ends the rounds."""
    placed = keep(voxels.select(by, "vi", "vj", voxel_id().alias("id"), "d", "marker"))
    rows = keep(_tile_parts(placed, by, tile))
    release(placed)
    parts = rows.where("other IS NULL").select(by, "id", "part")
    across = parts.select(by, F.col("id").alias("other"), F.col("part").alias("_far"))
    edges = rows.where("other IS NOT NULL").join(across, [by, "other"], "left").select(by, F.col("part").alias("a"), F.coalesce("part_other", "_far").alias("b"), F.struct((-F.col("lo")).alias("lo"), (-F.col("hi")).alias("hi"), F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).alias("face"))
    open_ = "a <> b AND NOT (a < 0 AND b < 0)"
    edges, steps = keep(edges.where(open_)), []
    while n := edges.count():
        if n <= few:
            steps.append(keep(_finished(edges, by)))
            break
        ends = edges.select(by, "face", F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("p")), F.struct(F.col("b").alias("c"), F.col("a").alias("p")))).alias("e")).select(by, "face", "e.c", "e.p")
        up = keep(ends.where("c >= 0").groupBy(by, "c").agg(F.min_by("p", "face").alias("p")))
        back = up.select(by, F.col("c").alias("p"), F.col("p").alias("_back"))
        # of two parts that took the same face, the lower is the end
        rooted = up.join(back, [by, "p"], "left").select(by, "c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        led = _shortened(keep(rooted), by)
        # a part that stays an end is named again, if at all, by a later round
        steps.append(led.where("c <> p"))
        of = lambda end, led=led: led.select(by, F.col("c").alias(end), F.col("p").alias(f"_{end}"))
        moved = edges.join(of("a"), [by, "a"], "left").join(of("b"), [by, "b"], "left").select(by, F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "face").where(open_)
        # of the faces between two parts only the first can be taken
        lower = moved.select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "face").groupBy(by, "a", "b").agg(F.min("face").alias("face"))
        done, edges = edges, keep(lower)
        release(done, up)
    if steps:
        # later rounds have fewer parts, so they are put together from the last one backwards
        whole = reduce(lambda later, led: led.join(later.select(by, F.col("c").alias("p"), F.col("p").alias("_to")), [by, "p"], "left").select(by, "c", F.coalesce("_to", "p").alias("p")).unionByName(later), steps[-2::-1], steps[-1])
        parts = parts.join(whole.select(by, F.col("c").alias("part"), "p"), [by, "part"], "left").select(by, "id", F.coalesce("p", "part").alias("part"))
    label = F.when(F.col("part") < 0, -F.col("part")).otherwise(0).cast("int")
    mask = (1 << BITS) - 1
    return parts.select(by, F.shiftright("id", 2 * BITS).cast("int").alias("vi"), F.shiftright("id", BITS).bitwiseAND(mask).cast("int").alias("vj"), F.col("id").bitwiseAND(mask).cast("int").alias("vk"), label.alias("label"))
