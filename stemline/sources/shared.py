"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder; one of our own only where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "stemline-checkpoints")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: the plan of a later round doesn't hold those before it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the tables of keep() that these frames read, once nothing else does."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            if where.getName().startswith("kept-"):
                where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
