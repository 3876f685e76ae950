"""Feature tables kept by plot and parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.config import Features
from stemline.sources.tables import exists


def cached(points: DataFrame, path: str, cfg: Features, compute: Callable[[DataFrame, Features], DataFrame], by: str = "plot") -> DataFrame:
    """Features of all plots of ``points``: those stored under these parameters with as many rows as the plot has are reused.

    The key is the full plot name and a hash of the parameters, so equal stems in two folders don't meet."""
    spark = points.sparkSession
    tag = hashlib.sha256(json.dumps(asdict(cfg), sort_keys=True).encode()).hexdigest()[:16]
    where = f"{path.rstrip('/')}/params={tag}"
    sizes = points.groupBy(by).agg(F.count("*").alias("n"))
    todo = points
    if exists(spark, where):
        stored = spark.read.parquet(where).groupBy(by).agg(F.count("*").alias("n"))
        todo = points.join(sizes.join(stored, [by, "n"], "left_semi").select(by), by, "left_anti")
    compute(todo, cfg).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(where)
    return spark.read.parquet(where).join(sizes.select(by), by, "left_semi")
