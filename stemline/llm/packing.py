"""Packing of token sequences into fixed windows by best-fit decreasing.

Documents longer than a window are first cut into full windows, which need no search.  The
remainders are packed longest first, each into the open window with the least room that
still holds it; a segment tree over the 0..size possible capacities finds it in
log(size) steps, whatever the number of windows.  Remainders are packed in groups of about
``group`` pieces dealt by a hash, so the work and the memory of a task do not grow with
the input; a group leaves at most a few windows underfilled.

Defined results: a null or empty text is one piece with the closing id alone; pieces are
never shared; ties go to the window opened first; repeated keys are separate documents
told apart by their order of text; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm import bpe
from stemline.llm.scratch import cut

SIZE = 4096
CLOSE = 2


class Rooms:
    """Open windows by remaining capacity, in a segment tree of the counts of 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _move(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._move(room, 1)

    def tightest(self, need: int) -> int:
        """The least capacity of need or more that an open window has, or -1."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, room: int) -> int:
        self._move(room, -1)
        return self.open[room].pop()


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length, longest first; windows are numbered from 0 in order of opening."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, opened = Rooms(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = rooms.tightest(need)
        if room < 0:
            at, room, opened = opened, size, opened + 1
        else:
            at = rooms.take(room)
        window[i], offset[i] = at, size - room
        if room > need:
            rooms.add(room - need, at)
    return window, offset


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, close: int = CLOSE) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, and ``ids`` themselves as little-endian bytes."""
    path = path or bpe.default_path()
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([close], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch in batches:
            for a, b in bpe.slices(batch, 1):
                part = batch.slice(a, b - a)
                row, start, got, total = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = enc.encode((t or "").encode()) + end
                    for s in range(0, len(ids), 4 * size):
                        row.append(i)
                        start.append(s // 4)
                        got.append(ids[s : s + 4 * size])
                        total.append(len(ids) // 4)
                out = [part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()), pa.array(total, pa.int64()), pa.array(got, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["k", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("k", key)


def pack(cut_pieces: DataFrame, key: str = "doc_id", size: int = SIZE, group: int = 20_000) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset.  Its rows are read twice: pass a written table."""
    kind = cut_pieces.schema[key].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    n = cut_pieces.count()
    groups = n // group + 1
    dealt = cut_pieces.select(F.coalesce(F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(groups)), F.lit(0)).cast("long").alias("g"), key, *names)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "start", "ids_crc32", "length", "doc_tokens"], kind="stable")
        window, offset = best_fit(pdf["length"].to_numpy(np.int64), size)
        pdf["sequence_id"] = pdf.pop("g").to_numpy(np.int64) * (1 << 32) + window
        pdf["offset"] = offset
        return pdf[[key, *names, "sequence_id", "offset"]]

    schema = f"{key} {kind}, " + ", ".join(f"{x} long" for x in [*names, "sequence_id", "offset"])
    return dealt.groupBy("g").applyInPandas(one, schema)


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, close: int = CLOSE, group: int = 20_000) -> DataFrame:
    """Pieces of all documents with their places: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut(pieces(docs, key, text, path, size, close).drop("ids")), key, size, group)
