"""Connected components of a link table, by contraction.

Each round points every node at its least smaller neighbour, shortens these pointers,
merges nodes into what they point at and drops the links that have become loops.  Links
shrink geometrically; nothing is collected, and a hub only ever takes part through joins
and minima that are combined before they are shuffled.  Pointers compress so well that millions
of them are small enough on disk to be broadcast, which would pass them whole through the driver;
so all joins are by sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm.scratch import cut, drop


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of each node that is not the least of its component; root is the least."""
    ordered = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    left = cut(links.select(*ordered(F.col(a), F.col(b))).where("u <> v").distinct())
    roots = None
    while not left.isEmpty():
        up = left.groupBy("u").agg(F.min("v").alias("r"))
        for _ in range(2):
            up = cut(up)
            next_up = up.select(F.col("u").alias("r"), F.col("r").alias("rr"))
            up = up.join(next_up.hint("merge"), "r", "left").select("u", F.coalesce("rr", "r").alias("r"))
        up = cut(up)
        if roots is None:
            roots = up.select(F.col("u").alias("id"), F.col("r").alias("root"))
        else:
            moved = roots.join(up.select(F.col("u").alias("root"), "r").hint("merge"), "root", "left").select("id", F.coalesce("r", "root").alias("root"))
            roots = cut(moved.unionByName(up.select(F.col("u").alias("id"), F.col("r").alias("root"))))
        to = up.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        moved = left.join(up.hint("merge"), "u").join(to.hint("merge"), "v", "left").select(*ordered(F.col("r"), F.coalesce("rv", "v"))).where("u <> v").distinct()
        left, done = cut(moved), left
        drop(done)
    if roots is None:
        return left.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots
