"""Removal of strings that repeat, by a sampled suffix array.

A *search* asks for windows of ``length`` tokens that also start anywhere else, the same
text included; tokens are bytes, or words (maximal runs outside ``\\x20\\x09-\\x0D``), of
which only the words count, not the space between them.  ``STRINGS`` are 400 bytes,
``PASSAGES`` more than 50 words; both can be asked for in one pass over the texts.

Sorting every suffix would move some twenty times the input, so suffixes are sampled by
content: the *anchor* of a window is the leftmost of its grams (64 bytes, 12 words) with
the least hash.  Equal windows have equal anchors at equal offsets, so it is enough to
compare windows whose suffixes at the anchor begin with the same leading tokens.  All the
windows of one anchor lie side by side; together they are its *context*.

1. Each text gives its anchors: the hash of the gram, and a fingerprint of the context.
2. Equal contexts are counted, combined before they are shuffled, which settles copies of
   any number: all windows of a context that occurs twice repeat.
3. Of the contexts that occur once but share their gram with others, the suffixes are
   range-partitioned by their leading tokens, by splitters that Spark samples.  The
   partitions sort their windows by multikey quicksort; equal leading tokens never lie
   on both sides of a boundary, so neighbours across it differ.
4. Grams that more contexts share than ``hot`` are not given to one task: their windows are
   counted by fingerprint, first in blocks of offsets (a block whose common core is
   unique holds no repeat, one whose whole extent repeats holds nothing else), then
   in smaller ones where a block is undecided, and last one by one.

Strings are judged on the input.  Comparisons beyond the leading tokens are by 64-bit
fingerprints within one gram.

Defined results: a null text is empty; a text shorter than a window loses nothing; repeated
rows are copies of each other, whatever their keys; matches never cross texts; an
empty table gives no rows; ``clean`` keeps other columns untouched whatever their names, drops
the bytes of a character that is cut in half, and takes the white space after removed words with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm import textvec
from stemline.llm.scratch import cut, drop, fresh_name

#: A task sorts at most HOT contexts of one gram (some 3 MB of text, 1.4 million windows); grams of more are counted in
#: blocks of these numbers of offsets, each a part of the one before; a search starts where a block is half a window or less.
HOT, BLOCKS = 4096, (64, 16, 4, 1)


@dataclass(frozen=True)
class Search:
    """Windows of ``length`` tokens (below 32768), anchored at grams of ``gram`` tokens; ``unit`` is bytes or words."""

    unit: str = "bytes"
    length: int = 400
    gram: int = 64

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.length < 1 << 15:
            raise ValueError("a search needs 0 < gram <= length < 32768")


STRINGS, PASSAGES = Search(), Search("words", 51, 12)


def tokens(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, where each row's begin): the bytes themselves, or a 64-bit hash of each word."""
    if unit == "bytes":
        return data, offsets
    starts, ends, row = textvec.words(data, offsets)
    return textvec.Prefix(data).spans(starts, ends), textvec.segments(row, len(offsets) - 1)


def _content(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds) of contexts that ``_contents`` wrote."""
    data, bounds = textvec.raw(column)
    return (data, bounds) if unit == "bytes" else (np.frombuffer(data.tobytes(), np.uint64), bounds // 8)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, by running minima of blocks from both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first start, last start, gram hash, context fingerprint), places within the row."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < length:
        return none
    prefix = textvec.Prefix(data)
    at = np.arange(n - gram + 1)
    hashed = prefix.spans(at, at + gram)
    ranked = (hashed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = (sliding_argmin(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    start = np.flatnonzero(np.arange(len(least)) + length <= offsets[row + 1])
    if not len(start):
        return none
    p, row = least[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    p, row, a, b = p[first], row[first], start[first], start[last]
    prints = textvec.mix(prefix.spans(a, b + length) + (p - a).astype(np.uint64))
    base = offsets[row]
    return row, p - base, a - base, b - base, hashed[p], prints


def _place(u: int, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Search, anchor, first and last start of a context in one number, for it is shuffled."""
    return (p << 33 | b - a << 18 | p - a << 3 | u).astype(np.int64)


def _placed(place: np.ndarray) -> tuple[np.ndarray, ...]:
    p = place.view(np.uint64) >> np.uint64(33)
    a = p.astype(np.int64) - (place >> 3 & 0x7FFF)
    return place & 7, p.astype(np.int64), a, a + (place >> 18 & 0x7FFF)


def _anchors(docs: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """(id, h, place, key, fp) of the anchors of docs (id, h, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, _, data, offsets in textvec.blocks(batch.column(2)):
                for u, search in enumerate(searches):
                    row, p, a, b, key, fp = anchors(*tokens(data, offsets, search.unit), search.length, search.gram)
                    key = textvec.mix(key ^ np.uint64(u))
                    at = pa.array(row + x)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(v.view(np.int64)) for v in (_place(u, p, a, b), key, fp)]], names=["id", "h", "place", "key", "fp"])

    return docs.mapInArrow(run, f"id {kind}, h long, place long, key long, fp long")


def _contents(docs: DataFrame, contexts: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """(id, h, u, p, a, key, n, hot, lead, content) of ``contexts`` (id, h, place, key, n, hot): their leading and all their tokens."""
    kind = docs.schema["id"].dataType.simpleString()
    wanted = contexts.groupBy("id", "h").agg(F.collect_list(F.struct("place", "key", "n", "hot")).alias("c"))
    joined = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["h"] == wanted["h"])).select(docs["id"], docs["h"], "text", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                body = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                c = batch.column(3).slice(i, 1).flatten()
                u, p, a, b = _placed(np.asarray(c.field("place")))
                read = {k: tokens(body, np.array([0, len(body)]), searches[k].unit)[0] for k in np.unique(u)}
                content = pa.array([read[k][x : y + searches[k].length].tobytes() for k, x, y in zip(u, a, b, strict=True)], pa.binary())
                lead = pa.array([read[k][x : x + searches[k].gram].tobytes() for k, x in zip(u, p, strict=True)], pa.binary())
                at = pa.array(np.zeros(len(p), np.int64))
                one = batch.slice(i, 1)
                places = [pa.array(u.astype(np.int8)), pa.array(p.astype(np.int32)), pa.array(a.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([one.column(0).take(at), one.column(1).take(at), *places, *[c.field(n) for n in ("key", "n", "hot")], lead, content], names=["id", "h", "u", "p", "a", "key", "n", "hot", "lead", "content"])

    return joined.mapInArrow(run, f"id {kind}, h long, u byte, p int, a int, key long, n long, hot boolean, lead binary, content binary")


def multikey(classes: np.ndarray, tokens: list[Callable[[np.ndarray], np.ndarray]]) -> np.ndarray:
    """Items that agree with another one in their class and in all tokens.

    Multikey quicksort of all classes side by side: each pass parts every run by the token of
    its middle item into less, equal and greater; only the equal part goes on to the next
    token, and runs of one item are done."""
    items = np.argsort(classes, kind="stable")
    run, depth = np.cumsum(np.diff(classes[items], prepend=classes[items[:1]]) != 0), np.zeros(len(items), np.int8)
    agreeing = []
    while len(items):
        first = np.flatnonzero(np.diff(run, prepend=-1))
        size = np.diff(np.append(first, len(items)))
        several = np.repeat(size > 1, size)
        ended = several & (depth == len(tokens))
        agreeing.append(items[ended])
        live = several & ~ended
        items, run, depth = items[live], run[live], depth[live]
        if not len(items):
            break
        value = np.empty(len(items), np.uint64)
        for k in range(len(tokens)):
            here = np.flatnonzero(depth == k)
            value[here] = tokens[k](items[here])
        first = np.flatnonzero(np.diff(run, prepend=-1))
        size = np.diff(np.append(first, len(items)))
        pivot = np.repeat(value[first + size // 2], size)
        part = (value >= pivot).astype(np.int8) + (value > pivot)
        run = np.repeat(np.arange(len(first)), size) * 3 + part
        order = np.argsort(run, kind="stable")
        items, run, depth = items[order], run[order], (depth + (part == 1))[order]
    return np.concatenate(agreeing) if agreeing else items


def repeats(lead: np.ndarray, offset: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of windows that occur in another context too.

    ``lead`` numbers the leading tokens of contexts, ``offset`` is the anchor's place in them, ``bounds`` where their tokens
    lie in ``data``."""
    count = np.diff(bounds) - length + 1
    owner = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = bounds[owner] + within
    prefix = textvec.Prefix(data)
    if data.dtype == np.uint8:  # eight bytes are compared at once
        words = np.lib.stride_tricks.sliding_window_view(data, 8)
        token = lambda k: lambda i: np.ascontiguousarray(words[at[i] + 8 * k]).view(">u8").ravel().astype(np.uint64)
    else:
        token = lambda k: lambda i: data[at[i] + k]
    classes = lead[owner] * (2 * length) + offset[owner] - within
    found = np.sort(multikey(classes, [token(0), token(1), lambda i: prefix.spans(at[i], at[i] + length)]))
    return owner[found], within[found]


def _runs(owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, from, to) of the byte runs that windows at increasing starts cover."""
    if not len(owner):
        return owner, start, start
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], start[last] + length


def _sorted_buckets(contexts: DataFrame, search: Search, most: int = 1 << 21) -> DataFrame:
    """(id, h, s, e): repeated runs of contexts that occur once, found within partitions sorted by leading tokens."""
    kind, length = contexts.schema["id"].dataType.simpleString(), search.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            data, bounds = _content(part.column("content"), search.unit)
            lead = np.asarray(part.column("lead").combine_chunks().dictionary_encode().indices).astype(np.int64)
            a = np.asarray(part.column("a")).astype(np.int64)
            owner, start = repeats(lead, np.asarray(part.column("p")) - a, data, bounds, length)
            once = np.asarray(part.column("n"))[owner] == 1
            owner, s, e = _runs(owner[once], start[once], length)
            at = pa.array(owner)
            out = part.select(["id", "h"]).take(at).combine_chunks()
            cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in out.columns]
            return pa.RecordBatch.from_arrays([*cols, pa.array(a[owner] + s), pa.array(a[owner] + e)], names=["id", "h", "s", "e"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                part = pa.Table.from_batches(held)
                lead = part.column("lead")
                cutoff = len(part) - 1
                while cutoff > 0 and lead[cutoff - 1] == lead[len(part) - 1]:
                    cutoff -= 1
                if cutoff:
                    for x in _split(part.slice(0, cutoff), most):
                        yield done(x)
                rest = part.slice(cutoff)
                held, size = rest.combine_chunks().to_batches(), rest.nbytes
        if held:
            for x in _split(pa.Table.from_batches(held), most):
                yield done(x)

    kept = contexts.select("id", "h", "p", "a", "n", "lead", "content")
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartitionByRange(n, "lead").sortWithinPartitions("lead").mapInArrow(run, f"id {kind}, h long, s long, e long")


def _split(part: pa.Table, most: int) -> Iterator[pa.Table]:
    """Slices of about ``most`` bytes that end where the leading tokens change."""
    lead = part.column("lead").combine_chunks()
    codes = np.asarray(lead.dictionary_encode().indices)
    change = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
    per = max(1, most * len(part) // max(part.nbytes, 1))
    first = 0
    while first < len(part):
        last = int(change[min(np.searchsorted(change, first + per), len(change) - 1)])
        yield part.slice(first, last - first)
        first = last


def _block_prints(asked: DataFrame, search: Search, size: int, parent: int | None) -> DataFrame:
    """(id, h, p, key, n, block, core, extent) of blocks of ``size`` offsets of ``asked`` (id, h, p, a, content, key, n, parents).

    A block's core is what all its windows share, its extent what they cover; the extent of a
    block that a context has only in part is null.  ``parents`` are the blocks of ``parent`` offsets to look into, null for all."""
    kind, length = asked.schema["id"].dataType.simpleString(), search.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _content(batch.column(4), search.unit)
            prefix = textvec.Prefix(data)
            p, a = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 3))
            most = p - a
            least = most - (np.diff(bounds) - length)
            if parent is None:
                lo, hi = least // size, most // size
                owner = np.repeat(np.arange(len(p)), hi - lo + 1)
                b = np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[owner]
            else:
                lists, per = batch.column(7), parent // size
                owner = np.repeat(np.arange(len(p)), np.asarray(lists.value_lengths()) * per)
                b = (np.asarray(lists.flatten()).astype(np.int64)[:, None] * per + np.arange(per)).ravel()
                inside = (b * size <= most[owner]) & (b * size + size - 1 >= least[owner])
                owner, b = owner[inside], b[inside]
            anchor = bounds[owner] + most[owner]
            near, far = b * size, b * size + size - 1
            core = prefix.spans(anchor - near, anchor - far + length)
            whole = (far <= most[owner]) & (near >= least[owner])
            extent = np.zeros(len(owner), np.uint64)
            w = np.flatnonzero(whole)
            extent[w] = prefix.spans(anchor[w] - far[w], anchor[w] - near[w] + length)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in (0, 1, 2, 5, 6)], pa.array(b.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(extent.view(np.int64), mask=~whole)], names=["id", "h", "p", "key", "n", "block", "core", "extent"])

    return asked.mapInArrow(run, f"id {kind}, h long, p int, key long, n long, block int, core long, extent long")


def _hot_blocks(contexts: DataFrame, search: Search, sizes: Sequence[int]) -> DataFrame:
    """(id, h, s, e) as ``_sorted_buckets`` finds them, by counts of fingerprints in blocks of falling ``sizes``, the last 1."""
    table = contexts.select("id", "h", "p", "a", "content", "key", "n")
    asked = table.withColumn("parents", F.lit(None).cast("array<int>"))
    sizes = [x for x in sizes if 2 * x <= search.length or x == 1]
    on, parts = ["key", "block"], []
    for size, parent in zip(sizes, (None, *sizes), strict=False):
        found = cut(_block_prints(asked, search, size, parent))
        extents = found.where("extent is not null").groupBy(*on, "extent").agg(F.count("*").alias("c")).where("c > 1").select(*on, "extent", F.lit(True).alias("all"))
        first, last = F.col("p") - (F.col("block") + 1) * size + 1, F.col("p") - F.col("block") * size + search.length
        parts.append(found.join(extents, [*on, "extent"]).where("n = 1").select("id", "h", first.cast("long").alias("s"), last.cast("long").alias("e")))
        if size == 1:
            break
        cores = found.groupBy(*on, "core").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        open_ = found.join(cores, [*on, "core"], "left_semi").join(extents, [*on, "extent"], "left")
        open_ = cut(open_.select("id", "h", "p", *on, "core", F.coalesce("all", F.lit(False)).alias("all")))
        # where a block is undecided for some contexts, its parts are counted for all that share its core
        undecided = open_.where(~F.col("all")).select(*on, "core").distinct()
        ask = open_.join(undecided, [*on, "core"], "left_semi").groupBy("id", "h", "p").agg(F.collect_list("block").alias("parents"))
        same = table["id"].eqNullSafe(ask["id"]) & (table["h"] == ask["h"]) & (table["p"] == ask["p"])
        asked = table.join(ask, same).select(*[table[c] for c in table.columns], "parents")
    return reduce(DataFrame.unionByName, parts)


def _spans(docs: DataFrame, searches: Sequence[Search], hot: int, blocks: Sequence[int]) -> DataFrame:
    """(id, h, spans array<struct<u, s, e>>) of docs (id, h, text) that hold repeats, in tokens of search u."""
    found = cut(_anchors(docs, searches))
    groups = cut(found.groupBy("key", "fp").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "place")).alias("at")))
    mixed = groups.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("key", (F.col("c") > hot).alias("hot"))
    contexts = groups.join(mixed, "key").select("at.*", "key", "n", "hot")
    contents = cut(_contents(docs, contexts, searches))

    u, p = F.col("place").bitwiseAND(7), F.shiftrightunsigned("place", 33)
    start = p - F.shiftright("place", 3).bitwiseAND(0x7FFF)
    lengths = F.element_at(F.array(*[F.lit(x.length) for x in searches]), (u + 1).cast("int"))
    copied = groups.where("n > 1").select("key", "fp")
    parts = found.join(copied, ["key", "fp"], "left_semi").select("id", "h", u.cast("byte").alias("u"), start.alias("s"), (start + F.shiftright("place", 18).bitwiseAND(0x7FFF) + lengths).alias("e"))
    for k, search in enumerate(searches):
        of = contents.where(F.col("u") == k)
        some = _sorted_buckets(of.where("not hot"), search)
        if not (hottest := of.where("hot")).isEmpty():
            some = some.unionByName(_hot_blocks(hottest, search, blocks))
        parts = parts.unionByName(some.withColumn("u", F.lit(k).cast("byte")))
    spans = cut(parts.groupBy("id", "h").agg(F.collect_list(F.struct("u", "s", "e")).alias("spans")))
    drop(found, groups, contents)
    return spans


def keep_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) == 0


def _runs_of(keep: np.ndarray) -> int:
    return int((np.diff(np.concatenate([[True], keep]).astype(np.int8)) == -1).sum())


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", strings: Search = STRINGS, passages: Search = PASSAGES, hot: int = HOT, blocks: Sequence[int] = BLOCKS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, n_passage_words, n_passages, kept binary) of every row.

    ``kept`` holds the bytes that no repeated string covers; ``n_passage_words`` counts the words that
    repeated passages cover and ``n_passages`` their maximal runs, which are reported and not removed."""
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, offsets in textvec.blocks(batch.column(1), 1 << 22):
                spans = batch.column(2).slice(x, y - x)
                removed, runs, inside, passed, kept = [], [], [], [], []
                for i in range(y - x):
                    body = data[offsets[i] : offsets[i + 1]]
                    masks = [np.ones(0, bool)] * 2
                    if spans[i].is_valid:
                        u, s, e = (np.asarray(spans[i].values.field(n)) for n in ("u", "s", "e"))
                        masks = [keep_mask(int(n), s[u == k], e[u == k]) for k, n in enumerate((len(body), e[u == 1].max(initial=0)))]
                        body = body[masks[0]]
                    for out, mask in ((removed, masks[0]), (inside, masks[1])):
                        out.append(int(len(mask) - mask.sum()))
                    runs.append(_runs_of(masks[0]))
                    passed.append(_runs_of(masks[1]))
                    kept.append(body.tobytes())
                counts = [pa.array(v, pa.int64()) for v in (removed, runs, inside, passed)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(np.diff(offsets)), *counts, pa.array(kept, pa.binary())], names=["k", "n_bytes", "n_removed", "n_spans", "n_passage_words", "n_passages", "kept"])

    schema = f"k {kind}, n_bytes long, n_removed long, n_spans long, n_passage_words long, n_passages long, kept binary"
    spans = _spans(named, (strings, passages), hot, blocks).withColumnRenamed("id", "_id").withColumnRenamed("h", "_h")
    joined = named.join(spans, named["id"].eqNullSafe(F.col("_id")) & (named["h"] == F.col("_h")), "left").select("id", "text", "spans")
    return joined.mapInArrow(run, schema).withColumnRenamed("k", key)


def digest(stripped: DataFrame, key: str = "doc_id") -> DataFrame:
    return stripped.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words", "n_passages")


def covered(body: np.ndarray, search: Search, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges of token ranges; words take the white space after them along."""
    if search.unit == "bytes":
        return start, end
    begins, _, _ = textvec.words(body, np.array([0, len(body)]))
    return begins[start], np.append(begins, len(body))[end]


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", searches: Sequence[Search] = (STRINGS, PASSAGES)) -> DataFrame:
    """``docs`` without the bytes of ``text`` that repeats of ``searches`` cover."""
    named = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    id_, h, found = fresh_name(docs, "_id", "_h", "_spans")
    spans = _spans(named, searches, HOT, BLOCKS).toDF(id_, h, found)
    joined = docs.join(spans, docs[key].eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text]) == F.col(h)), "left").drop(id_, h)

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(body: str | None, some) -> str | None:  # noqa: ANN001
            if body is None or some is None:
                return body
            body = np.frombuffer(body.encode(), np.uint8)
            keep = np.ones(len(body), bool)
            u, s, e = (np.array([x[n] for x in some]) for n in ("u", "s", "e"))
            for k, search in enumerate(searches):
                keep &= keep_mask(len(body), *covered(body, search, s[u == k], e[u == k]))
            return body[keep].tobytes().decode("utf-8", "ignore")

        return pd.Series([one(a, b) for a, b in zip(texts, cuts, strict=True)], dtype=object)

    fresh = F.when(F.col(found).isNull(), F.col(text)).otherwise(cut_out(F.col(text), F.col(found)))
    return joined.withColumn(text, fresh).drop(found)
