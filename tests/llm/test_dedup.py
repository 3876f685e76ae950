"""Deduplication operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stemline.llm import crosspolytope, minhash, suffixes
from stemline.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(texts):
    sets, groups, seen = {i: shingles(t) for i, t in texts.items()}, Sets(texts), defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in seen[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
        for x in s:
            seen[x].append(i)
    return sets, groups


def check_near(df, frame):
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    sets, groups = near(texts)
    got = frame(minhash.cluster(df))
    assert len(got) == len(texts)
    for i in texts:
        assert got.loc[i, "n_shingles"] == len(sets[i])
        assert got.loc[i, "component_id"] == groups.find(i)
        assert got.loc[i, "kept"] == (groups.find(i) == i)


def family(n=60, words=120, seed=0):
    """Copies of one text with some words changed: links near the threshold, in one hot bucket family."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(0, 5)):
            w[at] = f"v{k}_{at}"
        out.append((k, " ".join(w)))
    return out


def test_minhash(spark, documents, edges, nothing, frame):
    check_near(documents[0], frame)
    check_near(edges, frame)
    check_near(spark.createDataFrame(family(), "doc_id long, text string"), frame)
    # a large family of texts that are mostly too far from each other
    check_near(spark.createDataFrame(family(150, 90, 4), "doc_id long, text string"), frame)
    assert minhash.cluster(nothing).count() == 0
    kept = minhash.deduplicate(edges)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 1


def test_one_row_of_a_component_is_kept_whatever_its_key(spark):
    texts = {c: " ".join(f"{c}{i * i % 97}x{i}" for i in range(150)) for c in "abcdef"}
    nearly = texts["a"].replace("a0x0", "other")
    rows = [(5, texts["a"]), (5, texts["a"]), (None, texts["a"]), (None, nearly), (7, texts["b"]), (None, texts["b"]), (None, texts["c"]), (None, texts["c"])]
    rows += [(8, texts["d"]), (8, texts["e"]), (9, texts["e"]), (1, ""), (1, "")] + [(3, texts["f"])] * 8
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int").repartition(5)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(5, texts["a"]), (7, texts["b"]), (None, texts["c"]), (8, texts["d"]), (8, texts["e"]), (1, ""), (1, ""), (3, texts["f"])])
    cleaned = suffixes.clean(kept)
    assert Counter(r.text for r in cleaned.collect()) == Counter(r.text for r in kept.collect())


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**64, 4000, np.uint64))[:3000]
    a, b = x[:2700], x[300:]
    at = np.array([0, len(a), len(a) + len(b)])
    odd = minhash.odd_sketch(minhash.samples(np.concatenate([a, b]), at, 2048), 4096)
    differing = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
    assert minhash.estimate(differing, 2048, 4096) == pytest.approx(len(np.intersect1d(a, b)) / len(x), abs=0.05)
    assert minhash.most_bits(0.75, 200) < minhash.BITS / 2


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (30, 20), (20, 1), *[(100 + i, 101 + i) for i in range(25)]]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[30] == got[2] == got[3] == 1 and got[9] == got[8] == 7 and got[125] == 100 and 1 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def covered(bodies, length):
    """Per body a mask of the tokens that no window repeated anywhere covers."""
    n = Counter(tuple(b[i : i + length]) for b in bodies.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in bodies.items():
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if n[tuple(b[i : i + length])] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        out[k] = np.cumsum(edge[:-1]) == 0
    return out


def brute_strip(texts, length, words):
    body = {k: (t or "").encode() for k, t in texts.items()}
    runs = lambda keep: int((np.diff(np.r_[1, keep.astype(int)]) == -1).sum())
    by_byte, by_word = covered(body, length), covered({k: WORD.findall(b) for k, b in body.items()}, words)
    out = {}
    for k, b in body.items():
        keep, inside = by_byte[k], by_word[k]
        kept = np.frombuffer(b, np.uint8)[keep].tobytes() if len(b) else b""
        out[k] = (len(b), len(b) - len(kept), runs(keep), hashlib.sha256(kept).hexdigest(), int((~inside).sum()), runs(inside))
    return out


def brute_clean(texts, length=400, words=51):
    body = {k: t.encode() for k, t in texts.items()}
    by_byte, by_word = covered(body, length), covered({k: WORD.findall(b) for k, b in body.items()}, words)
    out = {}
    for k, b in body.items():
        starts = [m.start() for m in WORD.finditer(b)] + [len(b)]
        keep = by_byte[k].copy()
        for i in np.flatnonzero(~by_word[k]):
            keep[starts[i] : starts[i + 1]] = False
        out[k] = np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
    return out


def check_strip(df, frame, length=400, words=51, gram=64, word_gram=12, **more):
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    searches = suffixes.Search("bytes", length, gram), suffixes.Search("words", words, word_gram)
    got = frame(suffixes.digest(suffixes.strip(df, strings=searches[0], passages=searches[1], **more)))
    for k, want in brute_strip(texts, length, words).items():
        assert tuple(got.loc[k, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages"]]) == want, k


def test_suffixes_on_documents(documents, frame):
    check_strip(documents[0], frame)


@pytest.mark.parametrize("hot", [512, 0])
def test_suffixes_on_crafted_texts(spark, frame, hot):
    rng = np.random.default_rng(2)
    word = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage, line = word(130), word(45)
    rows = [word(60) + passage + word(70) for _ in range(8)] + [word(50) + passage[:90] + word(50), word(30) + passage[5:105] + "é" + word(40)]
    rows += ["ab" * 200, "ab" * 90 + word(20), line * 6, word(40) + line * 3, "z" * 99, "z" * 100, "z" * 101, word(500), None, ""]
    rows += [rows[0], passage[:100], passage[-100:] + word(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    check_strip(df, frame, 100, gram=16, hot=hot, blocks=(8, 2, 1))


@pytest.mark.parametrize("hot", [512, 0])
def test_passages_on_crafted_texts(spark, frame, hot):
    rng = np.random.default_rng(6)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = some(30)
    rows = [" ".join(some(rng.integers(0, 25)) + passage[rng.integers(0, 4) : rng.integers(24, 31)] + some(20)) for _ in range(12)]
    rows += ["\n\t".join(passage), " ".join(passage[:19]), " ".join(passage[:20]), " ".join(["ha"] * 40), " ".join(["ha"] * 19 + ["ho"] * 25), "é" * 30, "", None, " "]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    check_strip(df, frame, 400, words=20, word_gram=5, hot=hot, blocks=(4, 2, 1))


def test_clean_takes_passages_out_of_every_copy(spark):
    rng = np.random.default_rng(8)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1000, n))
    passage, short = some(51), some(50)
    parts = [(some(70), some(40)) for _ in range(4)]
    rows = [(i, f"{a}\n{passage} {b}", "x") for i, (a, b) in enumerate(parts[:2])] + [(i + 2, f"{a}\n{short} {b}", "y") for i, (a, b) in enumerate(parts[2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string")
    got = {r.doc_id: r for r in suffixes.clean(docs).collect()}
    assert [got[i].text for i in range(4)] == [f"{a}\n{b}" for a, b in parts[:2]] + [r[1] for r in rows[2:]]
    assert got[2]._spans == "y"


def test_suffix_edges(edges, nothing, frame):
    check_strip(edges, frame)
    assert suffixes.strip(nothing).count() == 0
    cleaned = suffixes.clean(edges)
    assert cleaned.columns == edges.columns and cleaned.count() == edges.count()


def test_multikey_finds_what_agrees():
    a, b = np.array([1, 1, 2, 1, 1], np.uint64), np.array([5, 6, 5, 5, 6], np.uint64)
    assert sorted(suffixes.multikey(np.zeros(5, int), [lambda i: a[i], lambda i: b[i]])) == [0, 1, 3, 4]
    assert not len(suffixes.multikey(np.zeros(0, int), [lambda i: a[i]]))
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 6, (3, 4000)).astype(np.uint64)
    classes = rng.integers(0, 40, 4000)
    n = Counter(zip(classes, *keys, strict=True))
    want = [i for i, k in enumerate(zip(classes, *keys, strict=True)) if n[k] > 1]
    assert sorted(suffixes.multikey(classes, [lambda i, k=k: k[i] for k in keys])) == want


def check_vectors(rows, df, frame, least=0.98):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    groups, links = Sets(range(len(rows))), Counter()
    for i, (_, u, p) in enumerate(rows):
        for j, (_, v, q) in enumerate(rows[:i]):
            if p is not None and p == q and sound(u) and sound(v) and len(u) == len(v):
                x, y = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    groups.join(i, j)
                    links[i] += 1
                    links[j] += 1
    keys = defaultdict(list)
    for i, (k, _, _) in enumerate(rows):
        keys[groups.find(i)].append(k)
    want = Counter()
    for i, (k, _, _) in enumerate(rows):
        named = [x for x in keys[groups.find(i)] if x is not None]
        c = min(named) if named else None
        want[(k, links[i], c, c == k)] += 1
    assert Counter(tuple(r) for r in crosspolytope.cluster(df).select("vec_id", "n_links", "component_id", "kept").collect()) == want


def test_vectors(spark, frame):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 64))
    rows = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=64) * rng.choice([0, 0.05, 0.14, 0.2])
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 64, 1), (303, [nan] * 64, 1), (304, [inf] + [1.0] * 63, 1), (305, [None] + [1.0] * 63, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [3.0], 1), (309, [5.0], 1), (310, rows[0][1], None), (311, [1e-30] * 64, 1), (312, [1e30] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check_vectors(rows, df, frame)
    assert crosspolytope.cluster(df.limit(0)).count() == 0


def test_vectors_with_repeated_and_null_keys(spark, frame):
    a, b, c = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5], [0.1, -4.0, 2.0]
    twice = lambda v: [2 * x for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, twice(a), 0), (3, twice(b), 0), (5, a, 1), (5, b, 1), (9, b, 1), (None, c, 0), (None, twice(c), 0), (None, a, 2), (4, twice(a), 2), (None, b, 2), (7, c, 2), (7, c, 2)]
    check_vectors(rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), frame)


def test_candidates_grow_with_the_links(spark):
    rng = np.random.default_rng(9)
    per = []
    for n in (1000, 8000):
        x = rng.normal(size=(n, 32))
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, vec array<double>, label int")
        per.append(crosspolytope.candidates(df, *crosspolytope.plan(n, 32, 0.98)).count() / n)
    assert max(per) < 3
    small, large = crosspolytope.plan(1000, 64, 0.98), crosspolytope.plan(10**9, 64, 0.98)
    assert large[0] > small[0] and large[1] > small[1]


def test_vectors_are_not_broadcast_through_the_driver(spark, monkeypatch):
    from stemline.llm import components

    plans = []

    def seen(df, cut=crosspolytope.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(crosspolytope, "cut", seen)
    monkeypatch.setattr(components, "cut", seen)
    # a chain, whose components take rounds
    u, v = np.linalg.qr(np.random.default_rng(8).normal(size=(64, 2)))[0].T
    rows = [(i, (np.cos(i / 6) * u + np.sin(i / 6) * v).tolist(), 1) for i in range(30)]
    df = crosspolytope.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert sum(r["kept"] for r in df.collect()) == 1 and not [p for p in plans if "Broadcast" in p]


def test_simulated_pairs_of_long_vectors_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    rate = crosspolytope.miss_rate(4096, 1, 0.98)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and 0.02 <= rate < 0.9


def test_hadamard_is_orthogonal():
    h = crosspolytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16))


@pytest.mark.parametrize("n", [500, 50_000, 10**8])
def test_probing_recall(n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    tables, hashes = crosspolytope.plan(n, 64, 0.98)
    (a, pa), (b, pb) = (crosspolytope.keys(v, tables, hashes) for v in (x, y))
    assert ((a == b) | (pa == b[:, :, None]).any(2) | (pb == a[:, :, None]).any(2)).any(1).all()


def test_whole_table(spark, data, frame):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_vectors(rows, spark.read.parquet(f"{data}/embeddings.parquet"), frame)
