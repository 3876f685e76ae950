"""Portable random numbers: the same on every cluster, in every engine and on every retry of a task."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A number in [0, 1): 52 bits of the MD5 digest of the parts, joined by bars.  A string names a column."""
    named = [F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in named])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number from two draws, by the polar form of Box and Muller."""
    u, v = draw(*parts, 1), draw(*parts, 2)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


#: The rounds of ``whole``: x becomes (x * x + c) modulo the prime 2**31 - 1.
PRIME, ROUNDS = (1 << 31) - 1, (40_507, 1_299_721, 7_368_787, 15_485_863)


def whole(a: Column, b: Column, c: Column) -> Column:
    """A number in [0, 2**31 - 1) of three small whole numbers, by squaring: far cheaper than a digest, for draws by the million."""
    x = F.pmod(a.cast("long") * 1_000_003 + b.cast("long") * 65_539 + c.cast("long") * 257 + 1, F.lit(PRIME).cast("long"))
    for k in ROUNDS:
        x = F.pmod(x * x + k, F.lit(PRIME).cast("long"))
    return x


def draw_of(*parts: object) -> float:
    """``draw`` of values, for kernels."""
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / (1 << 52)
