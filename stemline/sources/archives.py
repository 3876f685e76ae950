"""Arrays inside ZIP archives, read by Spark's own readers from any file system.

An archive is read whole by one task, so it may have at most 2 GB.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def members(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, member, content) of the files in all archives below a folder."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if not n.endswith("/"))
                    for name in names:
                        yield pd.DataFrame({"archive": [path], "member": [name], "content": [z.read(name)]})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "content").mapInPandas(one, "archive string, member string, content binary")


def arrays(found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(member, position, names long) of the members that are NumPy archives: one row per item of their equally long arrays."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for member, content in zip(frame["member"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    columns = {n: held[n].astype(np.int64) for n in names}
                yield pd.DataFrame({"member": member, "position": np.arange(len(columns[names[0]])), **columns})

    schema = "member string, position long, " + ", ".join(f"`{n}` long" for n in names)
    return found.where(F.col("member").endswith(".npz")).select("member", "content").mapInPandas(one, schema)


def predictions(spark: SparkSession, root: str, method: str, plot: str) -> DataFrame:
    """(member, position, semantic_pred, instance_ids) of one method and plot; no rows where no archive has them."""
    name = f"predictions/{method}/{plot}_instances.npz"
    return arrays(members(spark, root).where(F.col("member") == name), ("semantic_pred", "instance_ids"))
