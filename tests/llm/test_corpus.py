"""Language-model scores, source divergence and centroid clustering."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemline.llm import centroids, divergence, ppm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def out_of_training(key):
    return zlib.crc32(str(key).encode()) % 10 == 0


def brute_ppm(texts, order, share):
    """{key: log10 of the probability}, escape by escape with sets of excluded bytes."""
    seen = defaultdict(Counter)
    whole = {k: b"\xff" * order + (t or "").encode() + b"\xff" for k, t in texts.items()}
    for k, x in whole.items():
        if not out_of_training(k):
            for i in range(order, len(x)):
                for o in range(order + 1):
                    seen[x[i - o : i]][x[i]] += 1
    total = sum(seen[b""].values())
    kept = {c for c in seen if len(c) <= 2 or sum(seen[c].values()) * share >= total or set(c) == {255}}

    def log(x, i):
        excluded, out = set(), 0.0
        for o in range(order, -1, -1):
            c = x[i - o : i]
            if c not in kept or not seen[c]:
                continue
            left = {s: n for s, n in seen[c].items() if s not in excluded}
            if x[i] in left:
                return out + math.log10(left[x[i]] / (sum(left.values()) + len(left)))
            if left:
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
            excluded |= set(left)
        return out - math.log10(256 - len(excluded))

    return {k: sum(log(x, i) for i in range(order, len(x))) for k, x in whole.items()}


def brute_base(texts):
    tokens = {k: [*WORD.findall((t or "").translate(LOWER)), ""] for k, t in texts.items()}
    count = Counter(w for k, ws in tokens.items() if not out_of_training(k) for w in ws)
    total, distinct = sum(count.values()), len(count)
    log = lambda w: math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    return {k: (len(ws), sum(count[w] > 0 for w in ws), total, sum(map(log, ws))) for k, ws in tokens.items()}


@pytest.mark.parametrize(("order", "share"), [(2, 1 << 15), (3, 400), (4, 200), (4, 1 << 15)])
def test_scores_equal_brute_force(spark, order, share, frame, documents):
    texts = dict(documents[1].sort_values("doc_id")[["doc_id", "text"]].head(60).itertuples(index=False)) | {-1: None, -2: "", -5: "Zürich 🎉 " * 30, -6: "a"}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(5)
    got, want, base = frame(ppm.evaluate(df, order=order, share=share, common=50)), brute_ppm(texts, order, share), brute_base(texts)
    for k in texts:
        r = got.loc[k]
        assert r["score"] == pytest.approx(want[k], rel=1e-9) and r["held_out"] == out_of_training(k)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == base[k][:3] and r["base_score"] == pytest.approx(base[k][3], rel=1e-9)


@pytest.mark.parametrize(("order", "often"), [(4, 40), (4, 1 << 20), (3, 3000)])
def test_contexts_are_all_kept(spark, order, often, frame):
    # each context of three or four bytes is rarer than one in 32,768 predictions, but for the first ones of a text
    rng = np.random.default_rng(7)
    texts = {k: "".join(chr(c) for c in rng.integers(32, 127, 2500)) for k in range(40)}
    texts |= {k + 100: texts[k][:900] + texts[k + 1][:900] for k in range(20)} | {-1: None, -2: "Zürich 🎉 " * 3}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    got, want = frame(ppm.evaluate(df, order=order, often=often)), brute_ppm(texts, order, 1 << 60)
    assert any(map(out_of_training, texts))
    for k in texts:
        assert got.loc[k, "score"] == pytest.approx(want[k], rel=1e-9)


def test_places_hold_the_most_frequent():
    keys = np.random.default_rng(2).permutation(1 << 16)[:30000].astype(np.int64)
    places = ppm.Places(keys, keys * 0.5)
    value, missed = places.find(np.arange(1 << 16))
    held = np.ones(1 << 16, bool)
    held[missed] = False
    assert set(np.flatnonzero(held)) <= set(keys.tolist()) and held.sum() > 0.98 * len(keys) and (value == np.where(held, np.arange(1 << 16) * 0.5, 0)).all()
    assert held[keys[0]] and len(ppm.Places(keys[:0], np.zeros(0)).find(keys)[1]) == len(keys)


def test_probabilities_add_up_to_one(documents):
    x = np.frombuffer(b"\xff\xff" + b"abracadabra, abracadabra" + b"\xff", np.uint8).astype(np.int64)
    trie = ppm.Trie.of_pairs(x[:-2] << 8 | x[1:-1], x[2:], np.ones(len(x) - 2, np.int64))
    for logs in trie.logarithms():
        assert (10**logs).sum(1) == pytest.approx(np.ones(len(logs)))


def test_pieces_of_long_texts_score_alike(documents):
    import pyarrow as pa

    column = pa.array(["short", None, "ab" * 5000, "", "end"])
    for size in (7, 1000, 1 << 20):
        n = np.zeros(5, np.int64)
        for rows, starts, out in ppm.stretches(column, 3, size):
            np.add.at(n, rows, np.add.reduceat(ppm.predicted(starts, len(out), 3).astype(np.int64), starts))
        assert n.tolist() == [6, 1, 10001, 1, 4]


def test_scores_of_edges(spark, edges, nothing, frame):
    got = frame(ppm.evaluate(edges))
    assert len(got) == edges.count() and got.loc[0, "n_tokens"] == 1 and got.loc[0, "score"] == got.loc[1, "score"]
    assert (got["score"] < 0).all() and got.loc[6, "base_score"] == got.loc[7, "base_score"]
    assert ppm.evaluate(nothing).count() == 0
    nulls = frame(ppm.evaluate(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "b c")], "doc_id long, text string")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))))
    assert len(nulls) == 3 and not nulls.loc[-1, "held_out"].any()
    untrained = frame(ppm.evaluate(spark.createDataFrame([(next(i for i in range(99) if out_of_training(i)), "ab")], "doc_id long, text string")))
    assert untrained["score"].iloc[0] == pytest.approx(-3 * math.log10(256)) and untrained["base_score"].iloc[0] == 0


def test_longer_contexts_predict_better(documents, frame):
    scores = [frame(ppm.evaluate(documents[0], order=k)).query("held_out")["score"].sum() for k in (2, 4)]
    size = sum(len((t or "").encode()) + 1 for k, t in documents[1][["doc_id", "text"]].itertuples(index=False) if out_of_training(k))
    assert -scores[1] < -0.9 * scores[0] and -scores[1] / math.log10(2) < 3.5 * size


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least=3, top=200):
    docs = [(a or "", b or "", Counter(TERM.findall((t or "").translate(LOWER)))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        terms = sorted(t for t, n in Counter(t for d in own for t in d[2]).items() if n >= least)
        count = {s: sum((d[2] for d in own if d[1] == s), Counter()) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in terms) + len(terms)) for t in terms}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda a, b: math.floor(Fraction((a - b) ** 2, b))
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in p if o != s]
            over = [(f(p[s][t], q[t]), t) for t in terms if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, documents, edges, nothing):
    rows = [(r.lang, f"s{r.doc_id % 4}" if r.doc_id % 9 else None, r.text) for r in documents[1].itertuples() if r.doc_id < 90]
    rows += [("xx", "a", None), ("xx", "b", "one"), (None, None, "Éa éa ÉA b_b"), (None, "t", "éa b"), (None, "t", "éa B"), (None, "t", "b")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x")).repartition(6)
    assert sorted(map(tuple, divergence.audit(df, top=5).collect())) == brute_divergence(rows, top=5)
    flushed = divergence.tally(df, flush=10).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("df"))
    assert sorted(map(str, flushed.collect())) == sorted(map(str, divergence.tally(df).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("df")).collect()))
    assert divergence.audit(nothing).count() == 0
    assert {r.part for r in divergence.audit(edges).collect()} <= {"term"}


def brute_centroids(rows, k=8, rounds=10):
    usable = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    at = [e for i, e in sorted(((i, e) for i, e in usable if i is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        found = [min((square(e, c), j) for j, c in enumerate(at)) for _, e in usable]
        for j in range(len(at)) if step < rounds else ():
            if mine := [e for (_, e), f in zip(usable, found, strict=True) if f[1] == j]:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    each = Counter()
    for d, j in found:
        each[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((str(i), j, d, each[j], sum(each.values()), name[j]) for (i, _), (d, j) in zip(usable, found, strict=True))


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(i % 5, 0.3, 64).tolist()) for i in range(80)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (90, None), (91, [1.0] * 63), (92, [math.nan] * 64), (93, [None] + [1.0] * 63), (94, [math.inf] * 64), (95, []), (96, [0.0] * 64), (97, [-0.0005] * 64)]
    for some in (rows, rows[:3], [rows[0]] * 12, [(0, [1.0] * 64), (1, [1.0] * 64), (2, [2.0] * 64)]):
        df = spark.createDataFrame(some, "vec_id int, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("e", F.lit(1)).withColumn("_key", F.lit(None)).repartition(3)
        assert sorted((str(r[0]), *r[1:]) for r in centroids.cluster(df).collect()) == brute_centroids(some)
    empty = centroids.cluster(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="do not fit a long"):
        centroids.cluster(spark.createDataFrame([(1, [131072.0] * 64)], "vec_id int, embedding array<double>")).count()


def test_search_of_centroids_is_exact():
    rng = np.random.default_rng(1)
    for spread in (2, 1000, 1 << 26):
        x, c = rng.integers(-spread, spread, (500, 64)), rng.integers(-spread, spread, (8, 64))
        c[5] = c[1]
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        of, best = centroids.nearest(x, c)
        assert (of == every.argmin(1)).all() and (best == every.min(1)).all()
