"""Arithmetic that is defined everywhere, under ANSI rules too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` where b is 0 or either is null; null if the default is None."""
    value = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def cell(x: Column | str, origin: Column | str, size: float | Column) -> Column:
    """The cell of x on a grid from origin: floor((x - origin) / size)."""
    return F.floor((col(x) - col(origin)) / (F.lit(float(size)) if not isinstance(size, Column) else size)).cast("long")
