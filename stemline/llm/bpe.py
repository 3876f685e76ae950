"""Byte-pair encoding by forced-boundary splitting, and decoding, with a public vocabulary.

Two bytes that stand side by side inside no vocabulary token can't be merged by any
sequence of merges, so a cut between them changes nothing.  A word is cut at every such
pair, each fragment is encoded on its own by a merge engine that is given the vocabulary's
ranks, and the pieces are concatenated.  White space always cuts, so the ids of whole
chunks between white space are remembered, in bounded memory.

Defined results: a null or empty text has no ids and decodes to the empty string; the
strings of special tokens give their single ids, as the library does.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: the pattern by which this family of vocabularies splits words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
END = "</w>"
#: Stands for END in byte strings; no UTF-8 text holds this byte.
MARK = b"\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, others for the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Remembers results of a function of byte strings, forgets all of them when full, and never keeps long keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: bytes) -> bytes:
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """An encoder for vocabulary files with end-of-word merges and lower-casing normalisation."""

    def __init__(self, path: str, remember: int = 500_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letter = byte_letters()
        self.byte = byte = {c: b for b, c in letter.items()}
        self.path, self.library = path, None
        raw = lambda token: bytes(byte[c] for c in token.removesuffix(END)) + MARK * token.endswith(END)
        # a merge's rank is the rank of what it makes; a byte and the mark of a word's end merge before all else
        order = [*letter.values(), *[c + END for c in letter.values()], *[a + b for a, b in pairs]]
        ranks: dict[bytes, int] = {MARK: len(order)}
        for token in order:
            ranks.setdefault(raw(token), len(ranks) - 1)
        ranks[MARK] = len(ranks) - 1
        self.id_of = {r: self.vocab[t] for t in order if (r := ranks[raw(t)]) is not None}
        self.merges = tiktoken.Encoding("fragments", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        #: all pairs of bytes that some token holds side by side
        self.joined = {body[i : i + 2] for token in self.vocab if (body := raw(token).removesuffix(MARK)) for i in range(len(body) - 1)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens: list[str] = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in (self.vocab | self.special).items():
            self.tokens[i] = token
        self.chunks = Memo(self.chunk, remember)

    def cuts(self, word: bytes) -> list[int]:
        """Where the word's forced boundaries are, its two ends included."""
        joined = self.joined
        return [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined], len(word)]

    def fragment(self, part: bytes, last: bool) -> list[int]:
        ids = self.id_of
        return [ids[r] for r in self.merges(part + MARK if last else part)]

    def words(self, text: str) -> list[bytes]:
        """The normalised words of a text.  Where letters are not of the Latin blocks, whose classes all Unicode
        versions agree on, the vocabulary file's own normaliser and splitter decide."""
        if text.isascii():
            return [text.lower().encode()] if text.isalpha() else [w.encode() for w in WORD.findall(text.lower())]
        if max(text) < "\u0250":
            return [w.encode() for w in WORD.findall("".join(c.lower() for c in text))]
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in w) for w, _ in found]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens: normalise, split into words, cut, encode, concatenate."""
        ids: list[int] = []
        for word in self.words(text):
            at = self.cuts(word)
            if len(at) == 2:
                ids += self.fragment(word, True)
                continue
            for a, b in zip(at[:-1], at[1:], strict=True):
                ids += self.fragment(word[a:b], b == len(word))
        return ids

    def chunk(self, part: bytes) -> bytes:
        """Little-endian 32-bit ids of what stands between white space."""
        text, ids = part.decode(), []
        if self.is_special and "<|" in text:
            for x in self.is_special.split(text):
                ids += [self.special[x]] if x in self.special else self.plain(x)
        else:
            ids = self.plain(text)
        return array("I", ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a whole UTF-8 text."""
        known = self.chunks
        return b"".join([known[p] for p in text.split()])

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by one space, special tokens kept."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` text bytes, so that what a run makes stays small."""
    from stemline.llm.textvec import raw

    offsets = raw(batch.column(column))[1]
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(max(int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1, first + 1), n)
        yield first, last
        first = last


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, decoded: bool = True) -> DataFrame:
    """(key, ids array<int>, decoded string): whole texts, one row per input row."""
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b in slices(batch, 1):
                part = batch.slice(a, b - a)
                ids = [enc.encode((t or "").encode()) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
                flat = np.frombuffer(b"".join(ids), "<i4")
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    out.append(pa.array([enc.decode(flat[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["k", "ids", "decoded"][: len(out)])

    schema = f"k {kind}, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("k", key)


def digest(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
