"""Quality rules: base counts of words, symbols and repeats, and the fertility of a public tokeniser.

Fertility is measured on the words of a text, each encoded by the vocabulary on its own:
code points per token, the share of byte-fallback tokens, the share of tokens of symbols
alone (no letter, digit or mark of ordinary prose), and the entropy of the text's
tokens in bits, relative to what as many different tokens would have.  A text is rejected
where a measure leaves the band of its script; the script is that of most of its letters,
told from the lead bytes of their UTF-8 forms.

The bands are parameters.  The defaults are wide: they are set beyond what ordinary prose
of a script shows with the vocabulary, so that they reject codes, keyboard noise, mangled
encodings and repetition, not unusual words.

Defined results: a null text has no words; texts without words fail the base rules; lines
and 8-word windows are compared within one text by 64-bit fingerprints; repeated rows are
judged alike; an empty table gives no rows; ``keep`` returns the rows untouched, with
whatever other columns they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm import textvec
from stemline.llm.bpe import Memo

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW = 8

#: UTF-8 lead bytes of each script's letters; ASCII counts with Latin.
SCRIPTS = {"latin": (0xC3, 0xCA), "greek_cyrillic": (0xCD, 0xD5), "semitic": (0xD6, 0xE0), "indic": (0xE0, 0xE2), "east_asian": (0xE3, 0xEE)}
#: script: (least and most code points per token, most byte-fallback share, most symbol share, least relative entropy)
BANDS = {
    "latin": (1.5, 8.0, 0.10, 0.10, 0.35),
    "greek_cyrillic": (0.8, 6.0, 0.30, 0.10, 0.35),
    "semitic": (0.5, 5.0, 0.60, 0.15, 0.35),
    "indic": (0.2, 4.0, 0.98, 0.30, 0.30),
    "east_asian": (0.25, 3.0, 0.98, 0.30, 0.30),
    "other": (0.2, 8.0, 0.98, 0.50, 0.30),
}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Token ids of words, remembered."""

    def __init__(self, path: str, remember: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.fallback = np.array([self.model.is_byte(i) for i in range(n)])
        prose = set(".,;:!?'\"()-\u2013\u2014\u2026\u00bf\u00a1\u00ab\u00bb\u2018\u2019\u201c\u201d\u2581\u3001\u3002")
        self.symbol = np.array([not self.fallback[i] and all(not c.isalnum() and c not in prose for c in p.replace("\u2581", "") or ".") for i in range(n) for p in [self.model.id_to_piece(i)]])
        encode = self.model.encode_as_ids
        self.words = Memo(lambda w: np.array(encode(w.decode("utf-8", "replace")), "<u4").tobytes(), remember)


_KEPT: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _KEPT:
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _seen(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an equal value of the same owner came before, whether one comes before or after)."""
    order = np.lexsort((np.arange(len(owner)), value, owner))
    same = np.zeros(len(owner), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (value[order][1:] == value[order][:-1])
    before, either = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    before[order] = same
    either[order] = same | np.append(same[1:], False)
    return before, either


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(offsets) - 1
    space = textvec.SPACE[data]
    starts, ends, row = textvec.runs(~space, offsets)
    prefix = textvec.Prefix(data)
    at = textvec.segments(row, n)
    inner = (~space) & ((data & 0xC0) != 0x80)
    out = {"n_words": np.diff(at), "word_chars": _sums(inner, offsets), "n_symbols": _sums(SYMBOLS[data], offsets)}
    line_start, line_end, line_row = textvec.runs(data != 10, offsets)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    before, _ = _seen(line_row, prefix.spans(line_start, line_end))
    out["n_dup_lines"] = np.bincount(line_row[before], minlength=n)
    hashed, first = textvec.windows(prefix.spans(starts, ends), row, WINDOW)
    _, either = _seen(row[first], hashed)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, first[either], 1)
    np.add.at(edge, first[either] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS of the script of most letters, or len(SCRIPTS) where there are none."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    counts = [_sums((data >= lo) & (data < hi), offsets) for lo, hi in SCRIPTS.values()]
    counts[0] = counts[0] + _sums(ascii_letter, offsets)
    table = np.stack(counts)
    return np.where(table.max(0) > 0, table.argmax(0), len(SCRIPTS))


def fertility(data: np.ndarray, offsets: np.ndarray, word_chars: np.ndarray, enc: Pieces) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    body, known = data.tobytes(), enc.words
    each = [b"".join([known[w] for w in body[offsets[i] : offsets[i + 1]].split()]) for i in range(n)]
    at = np.cumsum([0, *[len(x) // 4 for x in each]])
    ids = np.frombuffer(b"".join(each), "<u4").astype(np.int64)
    tokens = np.diff(at)
    some = np.maximum(tokens, 1)
    owner = np.repeat(np.arange(n), tokens)
    pair = np.sort(owner << 20 | ids)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(pair)))
    whose = pair[first] >> 20
    share = count / some[whose]
    entropy = np.bincount(whose, -share * np.log2(share), minlength=n)
    return {
        "n_tokens": tokens,
        "chars_per_token": word_chars / some,
        "fallback_share": _sums(enc.fallback[ids], at) / some,
        "symbol_share": _sums(enc.symbol[ids], at) / some,
        "relative_entropy": np.where(tokens > 1, entropy / np.log2(np.maximum(tokens, 2)), 0.0),
    }


def judge(data: np.ndarray, offsets: np.ndarray, enc: Pieces, limit: np.ndarray) -> dict[str, np.ndarray]:
    """All counts and measures, the script, base_failed and kept; ``limit`` has a row of bounds for each script."""
    c = base_counts(data, offsets)
    c |= fertility(data, offsets, c["word_chars"], enc) | {"script": scripts(data, offsets)}
    low, high, fallback, symbols, entropy = limit[c["script"]].T
    c["base_failed"] = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    inside = (c["chars_per_token"] >= low) & (c["chars_per_token"] <= high) & (c["fallback_share"] <= fallback)
    c["kept"] = ~c["base_failed"] & inside & (c["symbol_share"] <= symbols) & (c["relative_entropy"] >= entropy)
    return c


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "fallback_share", "symbol_share", "relative_entropy")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, bands: dict[str, tuple[float, ...]] = BANDS) -> DataFrame:
    """(key, the base counts, base_failed, kept, n_tokens, the measures, script) of every row."""
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()
    names = [*SCRIPTS, "other"]
    limit = np.array([bands[s] for s in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces(path)
        for batch in batches:
            for a, b, data, offsets in textvec.blocks(batch.column(1)):
                c = judge(data, offsets, enc, limit)
                cols = [batch.column(0).slice(a, b - a), *[pa.array(c[x].astype(np.int64)) for x in COUNTS], pa.array(c["base_failed"]), pa.array(c["kept"]), pa.array(c["n_tokens"].astype(np.int64)), *[pa.array(c[x]) for x in MEASURES]]
                cols.append(pa.array([names[i] for i in c["script"]], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["k", *COUNTS, "base_failed", "kept", "n_tokens", *MEASURES, "script"])

    schema = f"k {kind}, " + ", ".join(f"{x} long" for x in COUNTS) + ", base_failed boolean, kept boolean, n_tokens long, " + ", ".join(f"{x} double" for x in MEASURES) + ", script string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("k", key)


def keep(docs: DataFrame, text: str = "text", path: str | None = None, bands: dict[str, tuple[float, ...]] = BANDS) -> DataFrame:
    """The rows of ``docs`` that pass, filtered in place: no shuffle, whatever the keys."""
    schema, columns = docs.schema, docs.columns
    path = path or default_path()
    names = [*SCRIPTS, "other"]
    limit = np.array([bands[s] for s in names])
    where = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces(path)
        for batch in batches:
            for a, b, data, offsets in textvec.blocks(batch.column(where)):
                yield batch.slice(a, b - a).filter(pa.array(judge(data, offsets, enc, limit)["kept"]))

    return docs.mapInArrow(run, schema)
