"""A reader of LAS point clouds as a Spark data source, after the public LAS 1.2-1.4 specification.

Uncompressed files with point formats 0 to 10; the extra dimension ``treeID`` gives
``tree_id``.  Each file is one or more ranges of bytes, so a large file is read by many tasks; the driver only lists
files, headers are read by the tasks.

    spark.dataSource.register(LasSource)
    spark.read.format("las").option("path", folder).load()
    load(spark, folder, plots=["SITE__one"], box={"x": (10, 20)})

``load`` hands plots and a box to the files: those of other plots are not listed, those whose header has another box are
not read, and other points leave no task.  These are options and not filters that Spark pushes, because Spark 4.1 seems to keep what was
pushed with the source: in a test, a later query of the same DataFrame lost rows.

This source opens files by path on the executors: the folder must be one that they share.
``scan`` reads any other file system through Spark's own reader, a file of at most 2 GB per task.
"""

from __future__ import annotations

import io
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stemline.schema import POINTS

#: The type codes of extra dimensions.
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
#: Record bytes of each point format.
FORMAT_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
#: points that a batch holds, bytes that a task reads
RANGE, BYTES = 1 << 19, 1 << 24


@dataclass
class Header:
    offset: int
    kind: int
    record: int
    count: int
    scale: tuple[float, ...]
    shift: tuple[float, ...]
    tree: tuple[int, str] | None
    #: least and greatest place of each axis; None where the file doesn't say
    box: tuple[tuple[float, float], ...] | None = None


def header(path: str) -> Header:
    with open(path, "rb") as f:
        return _header(f, path)


def _header(f: BinaryIO, path: str) -> Header:
    h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    size, offset, n_vlr, kind, record, count = struct.unpack_from("<HIIBHI", h, 94)
    if kind & 0xC0:
        raise ValueError(f"{path} is compressed")
    if h[25] >= 4:
        count = struct.unpack_from("<Q", h, 247)[0] or count
    scale, shift = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    bounds = struct.unpack_from("<6d", h, 179)
    # written as greatest and least of each axis; some writers leave them out
    box = tuple((bounds[2 * i + 1], bounds[2 * i]) for i in range(3)) if any(bounds) else None
    f.seek(size)
    tree, at = None, FORMAT_BYTES[kind]
    for _ in range(n_vlr):
        v = f.read(54)
        user, record_id, length = v[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", v, 18)
        body = f.read(length)
        if user == b"LASF_Spec" and record_id == 4:
            for i in range(0, length - 191, 192):
                code, name = body[i + 2], body[i + 4 : i + 36].split(b"\0")[0].decode("latin-1")
                if code in EXTRA_TYPES:
                    if name.lower() == "treeid":
                        tree = (at, EXTRA_TYPES[code])
                    at += np.dtype(EXTRA_TYPES[code]).itemsize
                else:
                    at += body[i + 3]
    return Header(offset, kind, record, count, scale, shift, tree, box)


def read(path: str, first: int, last: int) -> dict[str, np.ndarray]:
    h = header(path)
    return decode(h, np.fromfile(path, np.uint8, (last - first) * h.record, offset=h.offset + first * h.record))


def decode(h: Header, body: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of whole point records."""
    rows = body.reshape(-1, h.record)
    take = lambda at, kind: np.ascontiguousarray(rows[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    flags = rows[:, 14]
    modern = h.kind >= 6
    out = {a: take(4 * i, "<i4") * h.scale[i] + h.shift[i] for i, a in enumerate("xyz")}
    out["intensity"] = take(12, "<u2").astype(np.float32)
    out["return_number"] = (flags & (15 if modern else 7)).astype(np.int32)
    out["number_of_returns"] = ((flags >> 4) if modern else (flags >> 3) & 7).astype(np.int32)
    out["classification"] = (rows[:, 16] if modern else rows[:, 15] & 31).astype(np.int32)
    out["tree_id"] = take(*h.tree).astype(np.int32) if h.tree else np.zeros(len(rows), np.int32)
    return out


def encode(points: pd.DataFrame, scale: float = 0.01) -> bytes:
    """A LAS 1.2 file of point format 0 with the extra dimension ``treeID``, of points in file order."""
    extra = bytearray(192)
    extra[2], extra[4:10] = 5, b"treeID"
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, 192, b"") + bytes(extra)
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HIIBHI", head, 94, 227, 227 + len(vlr), 1, 0, 24, len(points))
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    rows = np.zeros(len(points), np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("light", "<u2"), ("flags", "u1"), ("code", "u1"), ("rest", "V4"), ("tree", "<u4")]))
    for i, a in enumerate("xyz"):
        rows[a] = np.rint(points[a].to_numpy() / scale)
        if len(points):
            struct.pack_into("<2d", head, 179 + 16 * i, rows[a].max() * scale, rows[a].min() * scale)
    rows["light"], rows["code"], rows["tree"] = points["intensity"], points["classification"], points["tree_id"]
    rows["flags"] = points["return_number"].to_numpy() | points["number_of_returns"].to_numpy() << 3
    return bytes(head) + vlr + rows.tobytes()


def scan(spark: SparkSession, root: str, pattern: str = "*.las") -> DataFrame:
    """The points of all files below a folder of any file system."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = content.as_buffer()
                h = _header(io.BytesIO(body), path)
                whole = np.frombuffer(body, np.uint8)
                for first in range(0, h.count, RANGE):
                    last = min(first + RANGE, h.count)
                    yield _rows(path, first, decode(h, whole[h.offset + first * h.record : h.offset + last * h.record]))

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "content").mapInArrow(one, POINTS)


def _keys(path: str) -> tuple[str, str]:
    """(institution, plot) of a file."""
    folder, stem = os.path.basename(os.path.dirname(path)), os.path.splitext(os.path.basename(path))[0]
    return folder, f"{folder}__{stem}"


def _rows(path: str, first: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    folder, plot = _keys(path)
    n = len(columns["x"])
    rows = {"plot": pa.array([plot] * n), "institution": pa.array([folder] * n), "point_id": pa.array(np.arange(first, first + n))}
    rows |= {k: pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({k: rows[k] for k in POINTS.names})


@dataclass
class Part(InputPartition):
    """The points whose records begin in a range of a file's bytes."""

    path: str
    first: int
    last: int


class LasReader(DataSourceReader):
    def __init__(self, root: str, plots: list[str] | None = None, box: dict[str, tuple[float, float]] | None = None):
        self.root, self.plots, self.box = root.removeprefix("file://"), plots, box or {}

    def partitions(self) -> list[Part]:
        if os.path.isfile(self.root):
            paths = [self.root]
        else:
            paths = sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if n.lower().endswith(".las"))
        wanted = [p for p in paths if self.plots is None or _keys(p)[1] in self.plots]
        return [Part(p, a, min(a + BYTES, n)) for p in wanted for n in [os.path.getsize(p)] for a in range(0, n, BYTES)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no parts
            return
        h = header(partition.path)
        if h.box and any(low - h.scale[i] > self.box[a][1] or high + h.scale[i] < self.box[a][0] for i, (a, (low, high)) in enumerate(zip("xyz", h.box, strict=True)) if a in self.box):
            return
        record = lambda at: min(max(-((h.offset - at) // h.record), 0), h.count)
        for first in range(record(partition.first), record(partition.last), RANGE):
            rows = _rows(partition.path, first, read(partition.path, first, min(first + RANGE, record(partition.last))))
            for a, (low, high) in self.box.items():
                rows = rows.filter(pc.and_(pc.greater_equal(rows.column(a), low), pc.less_equal(rows.column(a), high)))
            yield rows


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> StructType:
        return POINTS

    def reader(self, schema: StructType) -> LasReader:
        plots, box = (json.loads(self.options.get(name, "null")) for name in ("plots", "box"))
        return LasReader(self.options["path"], plots, box)


def load(spark: SparkSession, root: str, plots: list[str] | None = None, box: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The points below a folder, of some plots or within a box (axis: least, greatest, both included).

    Files of other file systems come through Spark's reader, whole."""
    if "://" in root and not root.startswith("file://"):
        points = scan(spark, root)
    else:
        spark.dataSource.register(LasSource)
        points = spark.read.format("las").option("path", root).option("plots", json.dumps(plots)).option("box", json.dumps(box)).load()
    if plots is not None:
        points = points.where(F.col("plot").isin(plots))
    for axis, (low, high) in (box or {}).items():
        points = points.where(F.col(axis).between(low, high))
    return points
