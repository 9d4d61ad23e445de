import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomewright.llm import wavelet as V
from tomewright.llm.tokenizer import TokenizerParams, encode, load

from .conftest import prose


def shard_of(ids, block_bits=64):
    a = np.array(ids, np.uint32)
    starts = np.array([0], np.int64) if len(a) else np.empty(0, np.int64)
    return V.Shard.of(V.encode_shard(a, np.arange(len(starts), dtype=np.int64), starts, V.WaveletParams(block_bits=block_bits)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400))
def test_access_count_occurrences(ids):
    s = shard_of(ids)
    assert s.n == len(ids) and s.decode().tolist() == ids and s.intact()
    assert s.access(np.arange(len(ids))).tolist() == ids and s.access(np.arange(len(ids))[::-1]).tolist() == ids[::-1]
    for token in {*ids[:5], 0, 301, 10_000, -1}:
        assert s.count(token) == ids.count(token)
        assert s.occurrences(token).tolist() == [i for i, x in enumerate(ids) if x == token]
        a, b = len(ids) // 3, len(ids) // 2
        assert s.count(token, a, b) == ids[a:b].count(token)
        assert s.occurrences(token, a, b).tolist() == [i for i in range(a, b) if ids[i] == token]


def test_many_blocks_and_wide_ids():
    ids = np.random.default_rng(1).integers(0, 200_000, 5000).tolist()
    s = shard_of(ids, 512)
    assert s.decode().tolist() == ids
    assert s.occurrences(ids[7]).tolist() == [i for i, x in enumerate(ids) if x == ids[7]]
    with pytest.raises(IndexError):
        s.access([5000])
    a, b = np.random.default_rng(2).integers(0, 5001, (2, 300))
    assert s.counts(ids[:300], np.minimum(a, b), np.maximum(a, b)).tolist() == [ids[min(x, y) : max(x, y)].count(t) for t, x, y in zip(ids, a.tolist(), b.tolist(), strict=False)]


def test_many_occurrences_at_once():
    """A token with hundreds of thousands of hits: all go up a plane together."""
    ids = np.random.default_rng(3).integers(0, 40_000, 2_000_000).astype(np.uint32)
    ids[::5] = 17
    s = V.Shard.of(V.encode_shard(ids, np.zeros(1, np.int64), np.zeros(1, np.int64), V.WaveletParams()))
    began = time.process_time()
    assert np.array_equal(s.occurrences(17), np.flatnonzero(ids == 17))
    assert time.process_time() - began < 20


def test_fingerprints_see_the_order():
    ids, starts = np.array([5, 6, 7, 5, 7, 6, 9], np.uint32), np.array([0, 3, 6])
    a = V.fingerprints(ids, starts)
    ids[[0, 1]] = ids[[1, 0]]
    b = V.fingerprints(ids, starts)
    assert a[0] != b[0] and a[1:].tolist() == b[1:].tolist()
    long = np.arange(3_000_000, dtype=np.uint32)
    some = np.arange(0, 3_000_000, 70_001)
    assert V.fingerprints(long, some)[7] == V.fingerprints(long, np.array([0, some[7], some[8]]))[1]
    with pytest.raises(ValueError, match="not a shard"):
        V.Shard.of(b"something else")


def test_documents_round_trip(odd_docs, no_docs, spark, tmp_path):
    p = V.WaveletParams(shard_tokens=3000)
    files = V.write_shards(odd_docs, f"file://{tmp_path}/shards", p)
    rows = V.read_documents(files, p.tokenizer.separator).collect()
    assert len(rows) == odd_docs.count() and all(r["intact"] for r in rows)
    texts = {(r["doc_id"], sum(map(int, encode(r["text"], p.tokenizer))) + p.tokenizer.separator) for r in odd_docs.collect()}
    assert {(r["doc_id"], r["token_sum"]) for r in rows} == texts
    by_hand = lambda t: [*map(int, encode(t, p.tokenizer)), p.tokenizer.separator]
    want = sorted((str(r["doc_id"]), len(t := by_hand(r["text"])), t[0], t.count(t[0])) for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["first_token"], r["n_first"]) for r in rows) == want
    decode = load(TokenizerParams()).decode
    back = []
    for f in files.collect():
        s = V.open_shard(f["file"])
        ids = s.decode().tolist()
        for a, b in zip(s.starts.tolist(), [*s.starts.tolist()[1:], s.n], strict=True):
            assert s.access([b - 1])[0] == p.tokenizer.separator
            back.append(decode(ids[a : b - 1]))
    assert sorted(back) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert V.tokenise(no_docs).count() == 0


def test_deterministic(make_docs, tmp_path):
    docs = make_docs([(i, prose(i, 50)) for i in range(20)]).coalesce(1)
    for name in ("a", "b"):
        V.write_shards(docs, f"file://{tmp_path}/{name}")
    read = lambda n: b"".join(f.read_bytes() for f in sorted((tmp_path / n).glob("*.wvl")))
    assert read("a") == read("b")
