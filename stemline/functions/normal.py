"""Normal distribution function and quantile as vectorised functions."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else _NORMAL.cdf(v)).astype(float)


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return p.map(lambda v: _NORMAL.inv_cdf(v) if v is not None and 0 < v < 1 else None).astype(float)
