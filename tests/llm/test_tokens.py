"""Encoding, packing and attribution against the libraries and brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemline.llm import attribution, bpe, packing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(documents, edges, frame, library):
    for df in (documents[0], edges):
        got, texts = frame(bpe.digest(bpe.encode(df))), frame(df.select("doc_id", "text"))
        for i, t in texts["text"].items():
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert got.loc[i, "n_tokens"] == len(ids)
            assert got.loc[i, "ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got.loc[i, "decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_forced_boundaries_are_never_inside_a_token():
    enc = bpe.encoder(bpe.default_path())
    byte = {c: b for b, c in bpe.byte_letters().items()}
    for token in list(enc.vocab)[::50]:
        body = bytes(byte[c] for c in token.removesuffix(bpe.END))
        assert enc.cuts(body) == [0, len(body)]
    assert len(enc.cuts(b"q\xc3zzxj")) > 2


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    lib = tokenizers.Tokenizer.from_file(bpe.default_path()) if not hasattr(test_bpe_on_any_text, "lib") else test_bpe_on_any_text.lib
    test_bpe_on_any_text.lib = lib
    got = np.frombuffer(bpe.encoder(bpe.default_path()).encode(text.encode()), "<u4").tolist()
    assert got == lib.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded():
    made = []
    m = bpe.Memo(lambda k: made.append(k) or k, 3)
    for k in (b"a", b"b", b"c", b"d", b"d", b"y" * 65):
        assert m[k] == k
    assert len(m) <= 3 and made == [b"a", b"b", b"c", b"d", b"y" * 65]


def brute_best_fit(lengths, size):
    room, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        able = [w for w in range(len(room)) if room[w] >= lengths[i]]
        w = min(able, key=lambda w: room[w]) if able else len(room)
        if not able:
            room.append(size)
        place[i] = size - room[w]
        room[w] -= lengths[i]
    return len(room), sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_equals_brute_force(lengths):
    window, offset = packing.best_fit(np.array(lengths, np.int64), 40)
    n, rooms = brute_best_fit(lengths, 40)
    used = np.bincount(window, lengths, minlength=n).astype(int) if lengths else np.zeros(0, int)
    assert len(used) == n and sorted(40 - used) == rooms


def test_packing(documents, edges, nothing, library):
    for df in (documents[0], edges):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        got = packing.packed(df, group=60).toPandas()
        for i, pieces in got.groupby("doc_id"):
            ids = library.encode(texts[i], add_special_tokens=False).ids + [2]
            at = 0
            for r in pieces.sort_values("start").itertuples():
                assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
                at += r.length
            assert at == len(ids)
        assert set(got["doc_id"]) == set(texts)
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= packing.SIZE
    assert packing.packed(nothing).count() == 0


def test_attribution_equals_brute_force(documents, edges, nothing, frame):
    enc = attribution.ranks(attribution.default_path())
    for df in (documents[0], edges):
        got, texts = frame(attribution.count_tokens(df)), frame(df.select("doc_id", "text"))
        for i, t in texts["text"].items():
            t = t or ""
            body, starts = t.encode(), [0]
            for k, b in enumerate(body):
                if b == 10 and k + 1 < len(body):
                    starts.append(k + 1)
            want, cross, at = [0] * len(starts), [0] * len(starts), 0
            owner = np.searchsorted(starts, np.arange(len(body)), "right") - 1
            for token in enc.encoding.encode_ordinary(t):
                n = len(enc.encoding.decode_single_token_bytes(token))
                votes = np.bincount(owner[at : at + n], minlength=len(starts))
                want[votes.argmax()] += 1
                cross[votes.argmax()] += int((votes > 0).sum() > 1)
                at += n
            s = got.loc[i, "sections"]
            assert [x["tokens"] for x in s] == want and [x["crossing"] for x in s] == cross
            assert got.loc[i, "n_tokens"] == sum(want) and sum(x["bytes"] for x in s) == len(body)
    assert attribution.count_tokens(nothing).count() == 0


def test_crossing_tokens_go_to_the_larger_part_and_ties_to_the_earlier():
    section, crosses = attribution.attribute(np.array([3, 7, 9, 13]), np.array([0, 4, 8]))
    assert section.tolist() == [0, 1, 1, 2] and crosses.tolist() == [False, True, True, False]
