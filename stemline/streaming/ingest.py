"""Incremental runs: each micro-batch of newly arrived plots goes through the batch functions.

No windows or watermarks: a plot is complete when its files arrive, and what is written is
replaced by (method, plot), so a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stemline.schema import POINTS
from stemline.sources.tables import write_predictions


def on_arrival(spark: SparkSession, source: str, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], schema: StructType = POINTS, once: bool = True) -> StreamingQuery:
    """Start reading Parquet files that arrive in ``source``; ``process`` turns a batch of points into prediction rows."""

    def batch(points: DataFrame, _: int) -> None:
        points.persist()
        try:
            if not points.isEmpty():
                write_predictions(process(points), target)
        finally:
            points.unpersist()

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
