"""Where queries and their SQL forms are kept, and what both forms share.

Doubles are rounded to 6 digits in both forms, for sums may differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.functions.draws import PRIME, ROUNDS
from stemline.plans.projections import METRICS_SQL, POINTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

P, M = f"WITH {POINTS_SQL}", f"WITH {METRICS_SQL}"
RP, RM = f"WITH RECURSIVE {POINTS_SQL}", f"WITH RECURSIVE {METRICS_SQL}"
LABEL = "CASE WHEN classification IN (1, 2) THEN 0 WHEN classification IN (4, 5, 6) THEN 1 ELSE -1 END"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r6(x: Column | str, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, 6).alias(name or x)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def draw_sql(*parts: object) -> str:
    """The portable draw of ``functions.draws`` in SQL."""
    return f"(CAST(CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', {', '.join(map(str, parts))})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0)"


def index_sql(seed: object, b: str, i: str, n: str) -> str:
    """A bootstrap index from 0 in SQL."""
    x = f"((CAST({seed} AS BIGINT) * 1000003 + CAST({b} AS BIGINT) * 65539 + CAST({i} AS BIGINT) * 257 + 1) % {PRIME})"
    for k in ROUNDS:
        x = f"(({x} * {x} + {k}) % {PRIME})"
    return f"CAST(FLOOR({x} * {n} / {PRIME}.0e0) AS BIGINT)"
