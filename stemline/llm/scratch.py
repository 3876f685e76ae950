"""Tables, shared scratch space and small helpers of the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where both are one machine may it be one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "stemline-checkpoints")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors then cost a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stemline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the tables of cut() that these frames read, once nothing else does."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            if where.getName().startswith("stemline-"):
                where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh_name(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names, each with as many underscores after it as no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
