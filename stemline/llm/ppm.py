"""Language-model scores by prediction by partial matching, beside smoothed word frequencies.

The model is a trie of byte contexts.  A byte is predicted in the longest context before it that the
trie has: with count c there, n bytes seen and t different ones, it has probability c / (n + t), and what it has not is an escape
with t / (n + t) to the context shorter by a byte, where the bytes that the longer one has are excluded; below the
empty context all bytes left are equally likely.  Before a text stand bytes 0xFF, which UTF-8 never has, and one 0xFF ends it, so
the probabilities of all texts add up to one.

The trie has every context of every training text up to ``order`` bytes, counted in one pass as grams of order + 1 bytes; a level's
grams are those of the level above without their first byte.  Levels are tables, whatever their size.  Grams that are at least one in ``often``
of all predictions (at most ``often`` of them, by that share) are sent to the tasks, the others of each document are joined with the table.
A gram that training texts don't have escapes level by level in joins, once for all documents: what a context excludes below
is told by four numbers, its n and t and those that its shorter context has left.  Contexts of up to two bytes, which the alphabet bounds, are
a dense table there.  ``share`` makes another, smaller model, where a context of three bytes or more is kept only if at least one in ``share`` of
all predictions stands in it; no query sets it.

The words' counts are a table, whatever its size.  Words that are at least one in ``common`` of all words (at most
``common`` of them, by that share) are sent to the tasks, the others of each document are joined with the table.

Defined results: a null text is empty and has the end token alone; a null key is neither held out nor learnt from; repeated
rows are scored alike; without training texts bytes are equally likely and the base is 0; an empty table gives no
rows.  Long texts are read in stretches; a task's memory grows with the distinct words of one document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemline.llm import textvec
from stemline.llm.scratch import cut, drop

ORDER, OFTEN, COMMON, FLUSH, GRAMS, EDGE = 4, 1 << 20, 1 << 16, 300_000, 1 << 21, 0xFF


def held_out(key: str) -> Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 10 == 0


def stretches(column: pa.Array, order: int, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, bytes): pieces of texts, each after ``order`` bytes of context and, where its text ends, before one 0xFF."""
    data, offsets = textvec.raw(column)
    pieces: list[tuple[int, int, int, bool]] = []
    total = 0

    def built() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.full(total, EDGE, np.uint8)
        starts = np.zeros(len(pieces), np.int64)
        at = 0
        for k, (row, a, b, ends) in enumerate(pieces):
            before = min(order, a - int(offsets[row]))
            starts[k] = at
            out[at + order - before : at + order + b - a] = data[a - before : b]
            at += order + b - a + ends
        return np.array([p[0] for p in pieces]), starts, out

    for row in range(len(offsets) - 1):
        a, end = int(offsets[row]), int(offsets[row + 1])
        while True:
            b = min(end, a + size)
            pieces.append((row, a, b, b == end))
            total += order + b - a + (b == end)
            if total >= size:
                yield built()
                pieces, total = [], 0
            if b == end:
                break
            a = b
    if pieces:
        yield built()


def predicted(starts: np.ndarray, n: int, order: int) -> np.ndarray:
    """Which bytes are predictions, not context."""
    mark = np.ones(n, bool)
    mark[(starts[:, None] + np.arange(order)).ravel()] = False
    return mark


def grams(out: np.ndarray, order: int) -> np.ndarray:
    """Each byte after the first ``order`` ones with its context, as a number (the last byte lowest)."""
    n = len(out) - order
    found = out[:n].astype(np.int64)
    for k in range(1, order + 1):
        found <<= 8
        found |= out[k : n + k]
    return found


@dataclass
class Trie:
    """Contexts of each order as sorted numbers (the last byte lowest) with counts of the 256 bytes after them."""

    contexts: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def of_pairs(context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Trie:
        """All contexts of orders 0 to 2, from counts of bytes after two bytes."""
        trie = Trie()
        for k in range(3):
            keys, where = np.unique(context & ((1 << 8 * k) - 1), return_inverse=True)
            table = np.zeros((max(len(keys), int(k == 0)), 256), np.int64)
            np.add.at(table, (where, symbol), n)
            trie.contexts.append(keys if k else np.zeros(1, np.int64))
            trie.counts.append(table)
        return trie

    def logarithms(self) -> list[np.ndarray]:
        """log10 of each byte's probability in every context, of each order."""
        return self.predictions()[0]

    def predictions(self) -> tuple[list[np.ndarray], np.ndarray]:
        """logarithms(), and for the last order's contexts log10 of what each byte has below them, the contexts' own bytes excluded."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self._predictions()

    def _predictions(self) -> tuple[list[np.ndarray], np.ndarray]:
        out: list[np.ndarray] = []
        left = np.zeros((0, 256))
        for k, counts in enumerate(self.counts):
            seen, n = counts > 0, counts.sum(1, keepdims=True)
            t = seen.sum(1, keepdims=True)
            if k == 0:
                below = np.broadcast_to(-np.log10(np.maximum(256 - t, 1)), counts.shape)
            else:
                up = np.searchsorted(self.contexts[k - 1], self.contexts[k] & ((1 << 8 * (k - 1)) - 1))
                above = self.counts[k - 1][up]
                n_left = np.where(seen, 0, above).sum(1, keepdims=True)
                t_left = (above > 0).sum(1, keepdims=True) - t
                escape = np.where(t_left > 0, np.log10(t_left / (n_left + t_left)), 0.0)
                below = np.where(above > 0, np.log10(above / (n_left + t_left)), escape + left[up])
            out.append(np.where(seen, np.log10(counts / (n + t)), np.where(t > 0, np.log10(t / (n + t)), 0.0) + below))
            left = below
        return out, left


class Places:
    """Values of grams, found by two hashes.  A gram that finds both its places taken by more frequent ones isn't held."""

    HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` in descending order of frequency."""
        self.tables = []
        for factor in self.HASHES:
            bits = max(4, (4 * len(keys)).bit_length())
            at = self._at(keys, factor, bits)
            first = np.unique(at, return_index=True)[1]
            held, held_values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            held[at[first]], held_values[at[first]] = keys[first], values[first]
            self.tables.append((factor, bits, held, held_values))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _at(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; positions of keys that aren't held)."""
        (factor, bits, held, values), (factor2, bits2, held2, values2) = self.tables
        at = self._at(keys, factor, bits)
        hit = held[at] == keys
        out = np.where(hit, values[at], 0.0)
        rest = np.flatnonzero(~hit)
        at = self._at(keys[rest], factor2, bits2)
        hit = held2[at] == keys[rest]
        out[rest[hit]] = values2[at[hit]]
        return out, rest[~hit]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def first_counts(docs: DataFrame, key: str, text: str, order: int, flush: int = FLUSH, most: int = GRAMS) -> DataFrame:
    """(word binary, gram long, n, n_all): counts of lower-cased words over training texts and over all (the end token is the empty word), and of
    order + 1 bytes in a row over training texts; a row has a word or a gram.  One pass; tasks add up before they shuffle."""

    def words(counts: dict[bool, Counter]) -> pa.RecordBatch:
        every = list(counts[True].keys() | counts[False].keys())
        learnt = [counts[True][w] for w in every]
        both = [a + counts[False][w] for a, w in zip(learnt, every, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.nulls(len(every), pa.int64()), pa.array(learnt, pa.int64()), pa.array(both, pa.int64())], names=["word", "gram", "n", "n_all"])

    def counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n), pa.array(n)], names=["word", "gram", "n", "n_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {True: Counter(), False: Counter()}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            learns = np.asarray(batch.column(0))
            for a, b, data, offsets in textvec.blocks(batch.column(1)):
                body, at = data.tobytes(), offsets.tolist()
                for i in range(b - a):
                    here = counts[bool(learns[a + i])]
                    here[b""] += 1
                    for found in textvec.word_lists(body, at[i], at[i + 1]):
                        here.update(found)
                    if len(here) > flush:
                        yield words(counts)
                        counts = {True: Counter(), False: Counter()}
            for _, starts, out in stretches(batch.column(1).filter(batch.column(0)), order):
                parts.append(np.unique(grams(out, order)[predicted(starts, len(out), order)[order:]], return_counts=True))
                if len(parts) == 32:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > most:
                        yield counted(*parts.pop())
        yield words(counts)
        if parts:
            yield counted(*_merged(parts))

    partial = docs.select(F.coalesce(~held_out(key), F.lit(False)), F.col(text)).mapInArrow(run, "word binary, gram long, n long, n_all long")
    return partial.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def levels(counted: DataFrame, order: int, total: int, share: int | None) -> dict[int, DataFrame]:
    """{k: (gram, n, n_of, t_of)} of orders 2 to ``order``: grams with their counts, and n and t of their contexts."""
    out = {}
    for k in range(order, 1, -1):
        counted = counted.groupBy((F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        context = F.shiftright("gram", 8)
        of = Window.partitionBy(context)
        level = counted.select("gram", "n", F.sum("n").over(of).alias("n_of"), F.count("*").over(of).alias("t_of"))
        counted = level
        if share and k > 2:
            level = level.where((F.col("n_of").cast("decimal(38,0)") * share >= total) | (context == (1 << 8 * k) - 1))
        out[k] = cut(level)
        if not share:
            counted = out[k]
    return out


def contexts(level: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """(context, n_of, t_of, n_left, t_left) of a level: what is seen in a context, and in the next shorter one of bytes that the context has not."""
    above = shorter.select(F.col("gram").alias("up"), F.col("n").alias("n_up"), F.col("n_of").alias("n_up_of"), F.col("t_of").alias("t_up_of"))
    both = level.withColumn("up", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(above.hint("merge"), "up")
    return both.groupBy(F.shiftright("gram", 8).alias("context")).agg(
        F.max("n_of").alias("n_of"), F.max("t_of").alias("t_of"), (F.max("n_up_of") - F.sum("n_up")).alias("n_left"), (F.max("t_up_of") - F.max("t_of")).alias("t_left")
    )


def escapes(missing: DataFrame, model: Model) -> DataFrame:
    """(gram, log) of grams that the highest level has not: the escapes down to where a gram's last byte is seen, and that byte there."""
    none = F.lit(None).cast("long")
    found = missing.select("gram", F.lit(0.0).alias("log"), F.lit(False).alias("done"), none.alias("n_left"), none.alias("t_left"))
    for k in range(model.order, 2, -1):
        level = model.levels[k]
        here = contexts(level, model.levels[k - 1], k).select("context", "n_of", "t_of", F.col("n_left").alias("n_next"), F.col("t_left").alias("t_next"))
        found = found.withColumns({"at": F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1), "context": F.shiftright(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1), 8)})
        found = found.join(level.select(F.col("gram").alias("at"), "n").hint("merge"), "at", "left").join(here.hint("merge"), "context", "left")
        # without a longer context nothing is excluded
        n, t = F.when(F.col("t_left").isNull(), F.col("n_of")).otherwise(F.col("n_left")), F.when(F.col("t_left").isNull(), F.col("t_of")).otherwise(F.col("t_left"))
        step = F.when(F.col("done"), 0.0).when(F.col("n").isNotNull(), F.log10(F.col("n") / (n + t))).when(t > 0, F.log10(t / (n + t))).otherwise(0.0)
        found = found.select("gram", (F.col("log") + step).alias("log"), (F.col("done") | F.col("n").isNotNull()).alias("done"), F.col("n_next").alias("n_left"), F.col("t_next").alias("t_left"))

    logs, below = model.trie.predictions()
    bases = np.cumsum([0, *[len(x) for x in logs]])
    one, short, last = np.zeros(256, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    one[model.trie.contexts[1]] = bases[1] + np.arange(len(model.trie.contexts[1]))
    short[:] = np.tile(one, 256)
    short[model.trie.contexts[2]] = bases[2] + np.arange(len(model.trie.contexts[2]))
    last[model.trie.contexts[2]] = np.arange(len(model.trie.contexts[2]))
    sent = missing.sparkSession.sparkContext.broadcast((np.concatenate(logs), short, model.trie.counts[2], below, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, short, counts, below, last = sent.value
        for batch in batches:
            gram, log = (batch.column(i).to_numpy() for i in (0, 1))
            log, done, fresh = log.copy(), np.asarray(batch.column(2)), np.asarray(batch.column(4).is_null())
            n, t = (batch.column(i).fill_null(0).to_numpy().astype(np.float64) for i in (3, 4))
            pair, symbol = gram >> 8 & 0xFFFF, gram & 0xFF
            i = np.flatnonzero(~done & fresh)
            log[i] += logs[short[pair[i]], symbol[i]]
            # a longer context was seen, so this one of two bytes was too
            i = np.flatnonzero(~done & ~fresh)
            seen, n, t, row = counts[last[pair[i]], symbol[i]], n[i], t[i], last[pair[i]]
            with np.errstate(divide="ignore", invalid="ignore"):
                log[i] += np.where(seen > 0, np.log10(seen / (n + t)), np.where(t > 0, np.log10(t / (n + t)), 0.0) + below[row, symbol[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log)], names=["gram", "log"])

    return found.mapInArrow(run, "gram long, log double")


@dataclass
class Model:
    order: int
    trie: Trie
    levels: dict[int, DataFrame]
    often: tuple[np.ndarray, np.ndarray]
    pruned: bool
    words: DataFrame
    common: dict[bytes, int]
    total: int
    distinct: int
    scratch: DataFrame

    @property
    def logs(self) -> DataFrame:
        """(gram, log) of all grams of the highest level."""
        return self.levels[self.order].select("gram", F.log10(F.col("n") / (F.col("n_of") + F.col("t_of"))).alias("log"))

    def log_of(self, n: int | np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, share: int | None = None, common: int = COMMON, often: int = OFTEN) -> Model:
    """Counts over all training texts, of words and of all contexts, as tables."""
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    first = cut(first_counts(docs, key, text, order))
    words = first.where("word IS NOT NULL").select("word", "n", "n_all")
    row = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1)), F.sum("n_all")).first()
    total, distinct, every = (int(x or 0) for x in row)
    most = words.where(F.col("n_all").cast("decimal(38,0)") * common >= every).collect()
    counted = first.where("gram IS NOT NULL").select("gram", "n")
    predictions = int(counted.agg(F.sum("n")).first()[0] or 0)
    found = levels(counted, order, predictions, share)
    gram, n = (found[2].select("gram", "n").toArrow().column(i).to_numpy().astype(np.int64) for i in (0, 1))
    model = Model(order, Trie.of_pairs(gram >> 8, gram & 255, n), found, (gram, n), bool(share), words, {bytes(r["word"]): r["n"] for r in most}, total, distinct, first)
    held = found[order].where(F.col("n").cast("decimal(38,0)") * often >= predictions).select("gram", "n", F.log10(F.col("n") / (F.col("n_of") + F.col("t_of")))).toArrow()
    ranked = np.argsort(-held.column(1).to_numpy(), kind="stable")
    model.often = (held.column(0).to_numpy()[ranked], held.column(2).to_numpy()[ranked])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    logs = {w: (float(model.log_of(n)), n > 0) for w, n in model.common.items()}
    sent, order = spark.sparkContext.broadcast((*model.often, logs)), model.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_logs, known = sent.value
        places = Places(often, often_logs)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            whole = np.zeros(batch.num_rows)
            others = [(np.zeros(0, np.int64),) * 3]
            for rows, starts, out in stretches(batch.column(2), order):
                gram, on = grams(out, order), predicted(starts, len(out), order)[order:]
                found, missed = places.find(gram)
                value = np.zeros(len(out))
                value[order:][on] = found[on]
                np.add.at(whole, rows, np.add.reduceat(value, starts))
                missed = missed[on[missed]]
                doc, gram = rows[np.searchsorted(starts, missed + order, "right") - 1], gram[missed]
                by = np.lexsort((gram, doc))
                doc, gram = doc[by], gram[by]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])[: len(doc)])
                others.append((doc[new], gram[new], np.diff(np.append(new, len(doc)))))
            doc, gram, times = (np.concatenate(x) for x in zip(*others, strict=True))
            for a, b, data, offsets in textvec.blocks(batch.column(2)):
                body, at = data.tobytes(), offsets.tolist()
                tokens, seen, base, rare, counts, ends = [], [], [], [], [], [0]
                for i in range(b - a):
                    n = Counter([b""])
                    for found in textvec.word_lists(body, at[i], at[i + 1]):
                        n.update(found)
                    tokens.append(n.total())
                    of = [(c, known.get(w)) for w, c in n.items()]
                    seen.append(sum(c for c, x in of if x and x[1]))
                    base.append(sum(sorted(c * x[0] for c, x in of if x)))
                    if len(missing := [w for w in n if w not in known]):
                        rare += missing
                        counts += [n[w] for w in missing]
                    ends.append(len(rare))
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(counts, pa.int64())], names=["w", "c"])
                cuts = np.searchsorted(doc, np.arange(a, b + 1))
                of = slice(cuts[0], cuts[-1])
                escaped = pa.StructArray.from_arrays([pa.array(gram[of]), pa.array(times[of])], names=["g", "c"])
                cols = [pa.array(np.arange(row, row + b - a)), *[batch.column(j).slice(a, b - a) for j in (0, 1)], pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(whole[a:b]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), escaped)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "k", "held_out", "n_tokens", "seen", "base", "score", "rare", "grams"])
                row += b - a

    schema = f"row long, k {kind}, held_out boolean, n_tokens long, seen long, base double, score double, rare array<struct<w: binary, c: long>>, grams array<struct<g: long, c: long>>"
    # written, so that a row keeps its number when a task is run again
    scored = cut(docs.select(F.col(key), F.coalesce(held_out(key), F.lit(False)), F.col(text)).mapInArrow(run, schema))
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.c").alias("c"))
    n = F.coalesce("n", F.lit(0))
    log = F.log10((n + F.lit(0.1)) / F.lit(model.total + 0.1 * (model.distinct + 1)))
    others = scored.select("row", (F.col("held_out") | F.col("k").isNull()).alias("unlearnt"), F.explode("grams").alias("x")).select("row", "unlearnt", F.col("x.g").alias("gram"), F.col("x.c").alias("c"))
    # all grams of a learnt text are in the table, if no context was left out
    missing = (others if model.pruned else others.where("unlearnt")).select("gram").distinct().join(model.logs.hint("merge"), "gram", "left_anti")
    every = model.logs.unionByName(cut(escapes(missing, model)))
    # a sum of decimals doesn't depend on the order of its rows
    exact, none = (lambda x: (F.col("c") * x).cast("decimal(38,12)")), F.lit(None)
    of_words = rare.join(model.words, "word", "left").select("row", F.when(n > 0, F.col("c")).otherwise(0).alias("seen"), exact(log).alias("base"), none.cast("decimal(38,12)").alias("score"))
    of_grams = others.join(every.hint("merge"), "gram", "left").select("row", F.lit(0).cast("long").alias("seen"), none.cast("decimal(38,12)").alias("base"), exact(F.col("log")).alias("score"))
    sums = of_words.unionByName(of_grams).groupBy("row").agg(F.sum("seen").alias("rare_seen"), F.sum("base").alias("rare_base"), F.sum("score").alias("rare_score"))
    zero = F.lit(0)
    return scored.join(sums, "row", "left").select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("seen") + F.coalesce("rare_seen", zero)).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rare_base").cast("double"), zero)).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("rare_score").cast("double"), zero)).alias("score"),
    )


def evaluate(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, share: int | None = None, common: int = COMMON, often: int = OFTEN) -> DataFrame:
    """Learn from the rows that are not held out, and score all rows."""
    model = fit(docs, key, text, order, share, common, often)
    found = score(docs, model, key, text)
    out = cut(found)
    drop(model.scratch, found)
    return out
