import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tomewright.llm import substring_dedup as D

from .conftest import prose


def brute(rows, length):
    """Spans by comparing all runs of words."""
    docs = [(d, h.tolist()) for (d, t), (_, h) in zip(rows, D._word_lists([t for _, t in rows]), strict=True) if d is not None and t]
    holders = {}
    for d, h in docs:
        for i in range(len(h) - length + 1):
            holders.setdefault(tuple(h[i : i + length]), set()).add(d)
    out = set()
    for d, h in docs:
        at = {i for i in range(len(h) - length + 1) if len(holders[tuple(h[i : i + length])]) > 1}
        if at:
            start = [i for i in at if not any(j in at for j in range(i - length, i))]
            for a in start:
                b = a
                while further := [j for j in range(b + 1, b + length + 1) if j in at]:
                    b = further[-1]
                out.add((d, a, b + length))
    return out


def found(docs, p):
    rows = D.repeated_spans(docs, p).collect()
    assert all(r["n_words"] == r["end"] - r["start"] for r in rows)
    out = {(r["doc_id"], r["start"], r["end"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(make_docs):
    passage, other = prose(500, 51), prose(501, 90)
    rows = [(i, prose(i, 150)) for i in range(15)]
    rows += [(20 + i, prose(100 + i, 30 + i) + " " + passage + " " + prose(200 + i, 40)) for i in range(4)]
    words = other.split()
    rows += [(30, other + " " + prose(300, 60)), (31, prose(301, 10) + " " + other), (32, " ".join([*words[:60], "changed", *words[61:]])), (33, passage + " " + other)]
    rows += [(40, prose(302, 49) + " x"), (41, prose(302, 49) + " y"), (42, prose(303, 50)), (43, prose(303, 50))]
    rows += [(50, "und " * 400), (51, "und " * 70 + prose(304, 20)), (52, prose(305, 60) + " mid " + prose(305, 60)), (53, None), (54, ""), (None, passage), (55, prose(306, 70)), (55, prose(306, 70)), (56, prose(307, 15_000)), (57, prose(308, 5) + " " + prose(307, 15_000))]
    docs = make_docs(rows, extra=True)
    got = found(docs, D.SubstringParams())
    assert got == brute(rows, 50)
    assert {d for d, *_ in got} == {20, 21, 22, 23, 30, 31, 32, 33, 42, 43, 50, 51, 56, 57}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abc", max_size=40), min_size=2, max_size=6), st.sampled_from([1, 2_000_000]))
def test_random_texts(make_docs, texts, segment):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    p = D.SubstringParams(least_words=6, k=3, segment_runs=segment)
    assert found(make_docs(rows), p) == brute(rows, 6)


def test_empty(no_docs, odd_docs):
    p = D.SubstringParams()
    assert found(no_docs, p) == set()
    assert {d for d, *_ in found(odd_docs, p)} == {6, 9}


def test_sampling_shares_an_edge():
    p = D.SubstringParams(least_words=12, k=4)
    rng = np.random.default_rng(0)
    for _ in range(200):
        common = rng.integers(0, 2**63, 12, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64), common, rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)]) for _ in range(2))
        assert set(D.sampled_edges(a, p)[1].tolist()) & set(D.sampled_edges(b, p)[1].tolist())


@pytest.mark.parametrize("w", [1, 2, 3, 7, 20, 35])
def test_sliding(w):
    x = np.random.default_rng(w).integers(0, 1000, 80).astype(np.uint64)
    assert D.sliding(x, w, np.minimum).tolist() == [x[i : i + w].min() for i in range(80 - w + 1)]


def test_compaction(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (7, 8), (8, 7), (9, 10), (11, 10), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26), (30, 30)]
    edges = spark.createDataFrame([(x,) for x in sorted({x for e in links for x in e} | {40})], "edge long")
    got = {r["edge"]: (r["path"], r["step"]) for r in D.compact(edges, spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {x: (x, 0) for x in (5, 6, 7, 8, 9, 10, 11, 30, 40)}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), **alone, **{20 + i: (20, i) for i in range(7)}}


def test_a_long_passage_is_one_unit(make_docs, monkeypatch):
    """Compacted paths carry the result: copies of a long passage are confirmed by one unit, and without paths nothing is found."""
    passage = prose(700, 3000)
    docs = make_docs([(1, prose(701, 40) + " " + passage), (2, passage + " " + prose(702, 60)), (3, passage)])
    asked = []
    inner = D._confirmed
    monkeypatch.setattr(D, "_confirmed", lambda x, p, parts: asked.append(x.selectExpr("aggregate(transform(arrays_zip(first, last), r -> r.last - r.first + 1), 0, (a, n) -> a + n) AS n").agg({"n": "sum"}).first()[0]) or inner(x, p, parts))
    assert found(docs, D.SubstringParams()) == {(1, 40, 3040), (2, 0, 3000), (3, 0, 3000)}
    assert asked[0] < 3 * 2 * 100  # of nearly 9,000 runs
    compact = D.compact
    monkeypatch.setattr(D, "compact", lambda edges, links: compact(edges, links).limit(0))
    assert found(docs, D.SubstringParams()) == set()
