"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes, one from the left and one from the right,
in segments of fixed length with fresh states; at every position both states give the
probability of each language, and a document's probabilities are the means over all its
positions.  The network is trained here, in numpy, by backpropagation through time on
a bounded sample: of every language that a labelled row has, at most ``per_language`` documents,
those with the least hash, and of each at most ``pieces`` segments of 64 bytes, cut where the text is.
The network is small (a few thousand weights), so it is sent with the tasks.

The byte 0 pads segments: it keeps the update gate shut, so states pass it unchanged, and
its positions have no vote.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any
labelled row everything is ``und``; repeated rows get equal predictions; ties go to the
language that sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.llm import textvec

SEGMENT, HIDDEN, PER_LANGUAGE, PIECES, LEARNT = 128, 8, 200, 16, 64
SHUT = 12.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """``inputs`` (2, 256, 3h), ``states`` (2, h, 3h), ``outputs`` (2, h, classes), ``bias`` (classes,); gates in the order update, reset, new."""

    inputs: np.ndarray
    states: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.outputs, self.bias]

    def pad(self) -> None:
        """The byte 0 keeps the update gate shut."""
        h = self.states.shape[1]
        self.inputs[:, 0] = 0
        self.inputs[:, 0, :h] = 2 * SHUT

    @staticmethod
    def fresh(classes: int, hidden: int, rng: np.random.Generator) -> Network:
        make = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        net = Network(make(2, 256, 3 * hidden, scale=0.3), make(2, hidden, 3 * hidden, scale=hidden**-0.5), make(2, hidden, classes, scale=hidden**-0.5), np.zeros(classes, np.float32))
        net.pad()
        return net

    def read(self, side: int, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (time, batch, h) of one direction over bytes (time, batch)."""
        steps, batch = x.shape
        h = self.states.shape[1]
        table, recur = self.inputs[side], self.states[side]
        state = np.zeros((batch, h), np.float32)
        out = np.empty((steps, batch, h), np.float32)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            a, u = table[x[t]], state @ recur
            gates = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            if trace is not None:
                trace.append((t, state, z, r, n, u[:, 2 * h :]))
            state = n + z * (state - n)
            out[t] = state
        return out

    def probabilities(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        logits = left @ self.outputs[0] + right @ self.outputs[1] + self.bias
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy of all positions of bytes x (time, batch) with classes y (batch,)."""
        traces: list[list] = [[], []]
        states = [self.read(s, x, traces[s]) for s in (0, 1)]
        d = self.probabilities(*states)
        d[:, np.arange(len(y)), y] -= 1
        d *= (x != 0)[:, :, None] / max((x != 0).sum(), 1)
        grads = [np.zeros_like(w) for w in self.weights()]
        grads[3] += d.sum((0, 1))
        h = self.states.shape[1]
        for s in (0, 1):
            grads[2][s] = np.einsum("tbh,tbc->hc", states[s], d, optimize=True)
            outward = d @ self.outputs[s].T
            carried = np.zeros_like(states[s][0])
            for t, before, z, r, n, u in reversed(traces[s]):
                g = outward[t] + carried
                dn = g * (1 - z) * (1 - n * n)
                du = np.concatenate([g * (before - n) * z * (1 - z), dn * u * r * (1 - r), dn * r], 1)
                grads[1][s] += before.T @ du
                carried = g * z + du @ self.states[s].T
                du[:, 2 * h :] = dn
                np.add.at(grads[0][s], x[t], du)
        return grads


def cut_segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (segments, length), row of each segment) of whole rows, padded with 0."""
    size = np.diff(offsets)
    count = -(-size // length)
    row = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + within * length
    at = start[:, None] + np.arange(length)
    inside = at < offsets[row + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8), row


def train(pieces: list[bytes], labels: list[int], classes: int, segment: int = LEARNT, hidden: int = HIDDEN, steps: int | None = None, batch: int = 96, seed: int = 5) -> Network:
    """Adam on random pieces, as many of each class; deterministic.  More classes than 16 have more steps."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(classes, hidden, rng)
    bodies = [np.frombuffer(t, np.uint8)[:segment] for t in pieces]
    of = [np.flatnonzero(np.array(labels) == c) for c in range(classes)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    steps = steps or 450 * max(1, -(-classes // 16))
    for step in range(1, steps + 1):
        y = rng.permutation((np.arange(batch) + step * batch) % classes)
        x = np.zeros((segment, batch), np.uint8)
        for k, c in enumerate(y):
            body = bodies[of[c][rng.integers(len(of[c]))]]
            x[: len(body), k] = body
        rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for w, g, (m, v) in zip(net.weights(), net.gradients(x, y), moments, strict=True):
            np.clip(g, -0.5, 0.5, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        net.pad()
    return net


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT, batch: int = 4096) -> np.ndarray:
    """Mean position probabilities (rows, classes); 0 for rows without bytes."""
    pieces, row = cut_segments(data, offsets, segment)
    total = np.zeros((len(offsets) - 1, len(net.bias)))
    votes = np.zeros(len(offsets) - 1)
    for a in range(0, len(row), batch):
        x = np.ascontiguousarray(pieces[a : a + batch].T)
        here = x != 0
        p = net.probabilities(net.read(0, x), net.read(1, x)) * here[:, :, None]
        np.add.at(total, row[a : a + batch], p.sum(0, dtype=np.float64))
        np.add.at(votes, row[a : a + batch], here.sum(0))
    return total / np.maximum(votes, 1)[:, None]


def held_out(key: str):  # noqa: ANN201
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> DataFrame:
    """(lang, pieces array<binary>) of at most per_language documents a language outside the held-out fifth, pieces drawn by hash."""
    usable = docs.where(F.col(lang).isNotNull() & F.coalesce(~held_out(key), F.lit(False)) & F.col(text).rlike(r"\p{L}"))
    body, order = F.encode(F.col(text), "UTF-8"), F.xxhash64(key, text)
    spread = F.greatest(F.octet_length(text) - LEARNT + 1, F.lit(1))
    # a short text has fewer pieces, so that all are drawn about as often
    several = F.sequence(F.lit(1), F.least(F.lit(pieces), F.ceil(F.octet_length(text) / LEARNT).cast("int")))
    cuts = F.transform(several, lambda i: F.substring(body, (F.pmod(F.xxhash64(order, i), spread) + 1).cast("int"), F.lit(LEARNT)))
    # the rank is cut to per_language before the shuffle, so no language meets in one task, and texts stay where they are
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_order", "pieces"))
    few = usable.select(F.col(lang).alias("lang"), order.alias("_order"), cuts.alias("pieces"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("lang", "pieces")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> tuple[Network | None, list[str]]:
    """A network and its languages; per language at most per_language * pieces segments reach the driver."""
    rows = sorted((r[0], bytes(x)) for r in sample(docs, key, text, lang, per_language, pieces).collect() for x in r[1])
    names = sorted({r[0] for r in rows})
    if not names:
        return None, []
    of = {n: i for i, n in enumerate(names)}
    return train([r[1] for r in rows], [of[r[0]] for r in rows], len(names)), names


def predict(docs: DataFrame, net: Network | None, names: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, and the probabilities of ``names`` in order) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key), F.coalesce(held_out(key), F.lit(False)), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textvec.blocks(batch.column(3)):
                lettered = np.asarray(batch.column(2).slice(a, b - a))
                if net is None:
                    p = np.zeros((b - a, 1))
                    lettered = np.zeros(b - a, bool)
                else:
                    p = pooled(net, data, offsets)
                best = p.argmax(1)
                guess = pd.Series(np.array([*names, "und"], object)[np.where(lettered, best, len(names))])
                score = np.where(lettered, np.clip(p[np.arange(b - a), best], 0, 1), 0.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in (0, 1)], pa.array(guess, pa.string()), pa.array(score), lists], names=["k", "held_out", "lang_pred", "score", "probabilities"])

    return given.mapInArrow(run, f"k {kind}, held_out boolean, lang_pred string, score double, probabilities array<double>").withColumnRenamed("k", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return predict(docs, *fit(docs, key, text, lang), key, text)
