"""Token counts of sections, by offsets into one encoding of the whole document.

A document is encoded once, whole; the byte spans of its tokens follow from the bytes of
each token, and are joined with the spans of the sections as intervals: both are sorted, so
one binary search per side suffices.  A token that crosses a boundary goes as a whole to the
section that holds most of its bytes, and to the earlier one if several hold as many.

Sections are by default the lines of a text, each with the newline that ends it; any
function of a text that returns increasing byte offsets beginning with 0 may be given.

Defined results: a null or empty text has no tokens and one empty section; every token is
counted in exactly one section, so the sections of a document sum to its tokens; repeated
rows are reported each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def lines(text: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(text)]])


class Ranks:
    """An encoder for rank files, and the byte length of each of its tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte offsets of their ends)."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
        return ids, np.cumsum(self.length[ids])


_KEPT: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    if path not in _KEPT:
        _KEPT[path] = Ranks(path)
    return _KEPT[path]


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary), from token ends and section starts.

    Tokens lie end to end from 0, and so do sections; the last section never ends."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    section, crosses = first.copy(), last > first
    for i in np.flatnonzero(crosses):
        edge = np.concatenate([[starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]])
        section[i] = first[i] + int(np.argmax(np.diff(edge)))
    return section, crosses


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, sections: Callable[[bytes], np.ndarray] = lines) -> DataFrame:
    """One row per document: key, n_tokens, and ``sections``: array<struct<start, bytes, tokens, crossing>>.

    ``start`` and ``bytes`` place the section in the UTF-8 text; ``crossing`` counts those of its tokens that cross
    a boundary."""
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([(n, pa.int64()) for n in ("start", "bytes", "tokens", "crossing")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stemline.llm.bpe import slices

        enc = ranks(path)
        for batch in batches:
            for a, b in slices(batch, 1):
                part = batch.slice(a, b - a)
                n_tokens, cols, at = [], [[], [], [], []], [0]
                for t in part.column(1).to_pylist():
                    t = t or ""
                    body = t.encode()
                    bounds = np.asarray(sections(body), np.int64)
                    _, ends = enc.spans(t)
                    section, crosses = attribute(ends, bounds) if len(ends) else (np.zeros(0, np.int64), np.zeros(0, bool))
                    n_tokens.append(len(ends))
                    cols[0].append(bounds)
                    cols[1].append(np.diff(np.append(bounds, len(body))))
                    cols[2].append(np.bincount(section, minlength=len(bounds)))
                    cols[3].append(np.bincount(section[crosses], minlength=len(bounds)))
                    at.append(at[-1] + len(bounds))
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=[f.name for f in item])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], names=["k", "n_tokens", "sections"])

    schema = f"k {kind}, n_tokens long, sections array<struct<start:long,bytes:long,tokens:long,crossing:long>>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("k", key)


def digest(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the number of tokens, sections and crossing tokens, and the tokens of each section in order."""
    return counted.select(
        key, "n_tokens",
        F.size("sections").cast("long").alias("n_sections"),
        F.aggregate("sections", F.lit(0).cast("long"), lambda s, x: s + x["crossing"]).alias("n_crossing"),
        F.array_join(F.transform("sections", lambda x: x["tokens"].cast("string")), ",").alias("section_tokens"),
    )
