"""Distances and choices over fixed-width arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemline.functions.guards import col


def squared_distance(a: Column | str, b: Column | str) -> Column:
    terms = F.zip_with(col(a), col(b), lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def argmax(a: Column | str) -> Column:
    """Index from 0 of the greatest item, the first of equals."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def gather(a: Column | str, index: Column | str) -> Column:
    """Items of ``a`` at the 0-based positions in ``index``; null where there is none."""
    return F.transform(col(index), lambda i: F.get(col(a), i.cast("int")))
