import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomewright.llm import decontaminate as C
from tomewright.llm.text import Words

from .conftest import prose

BENCH = "item_id bigint, text string, doc_id string"


def words_of(text):
    w = Words([text])
    return w.hashes.tolist()


def brute(docs, items, p):
    """(doc_id, item_id) of exact phrases."""
    out = set()
    for d, text in docs:
        t = words_of(text)
        for i, item in items:
            w = words_of(item)
            if d is None or i is None or len(w) < p.least_words:
                continue
            n = min(p.window, len(w))
            runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if any(tuple(t[k : k + n]) in runs for k in range(len(t) - n + 1)):
                out.add((d, i))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=14), min_size=1, max_size=4), st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=7), min_size=1, max_size=3))
def test_segments_against_brute_force(docs, items):
    p = C.DecontaminationParams(window=3, least_words=2)
    g = C.Segment.build(list(range(len(docs))), [np.array(d, np.uint64) for d in docs])
    g = C.Segment.load(*g.dump())
    freq = {w: sum(d.count(w) for d in docs) for w in range(4)}
    t = C.make_tests([(i, np.array(x, np.uint64)) for i, x in enumerate(items)], freq, p)
    found = [m for m in C.search(g, t, p) if m[2] == "phrase"]
    expected = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            n = min(3, len(item))
            if len(item) >= 2 and any(doc[a : a + n] == item[b : b + n] for a in range(len(doc) - n + 1) for b in range(len(item) - n + 1)):
                expected.add((d, i))
    assert {(m[0], m[1]) for m in found} == expected
    for d, i, _, a, b, x, y in found:
        assert docs[d][x:y] == items[i][a:b]


def test_documents(spark, make_docs):
    items = [(1, prose(100, 30)), (2, prose(101, 14)), (3, "too short"), (4, None), (None, prose(102, 20)), (5, ""), (1, prose(100, 30)), (6, prose(103, 9))]
    rows = [(i, prose(i, 300)) for i in range(30)]
    rows += [(40, prose(1, 50) + " " + items[0][1].upper() + " " + prose(2, 50)), (41, items[1][1]), (41, items[1][1]), (42, prose(3, 20_000) + " " + items[7][1] + "!!"), (43, None), (44, ""), (None, items[0][1])]
    docs = make_docs(rows, extra=True)
    bench = spark.createDataFrame([(*x, "clash") for x in items], BENCH)
    found = C.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["kind"] == "phrase"} == brute(rows, items, C.DecontaminationParams()) == {(40, 1), (41, 2), (42, 6)}
    assert sum(r["doc_id"] == 41 for r in found) == 2
    kept = C.reject(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in (40, 41, 42))


@pytest.mark.parametrize("pass_words", [2_000_000, 5])
def test_near_matches(spark, make_docs, pass_words):
    item = prose(100, 40).split()
    changed = item[:18] + ["quite"] + item[18:30] + ["unknown"] + item[31:]
    rows = [(1, prose(1, 200) + " " + " ".join(changed) + " " + prose(2, 200)), (2, prose(9, 400)), (3, " ".join(sorted(item)))]
    bench = spark.createDataFrame([(1, " ".join(item), ""), (2, prose(200, 20), "")], BENCH)
    p = C.DecontaminationParams(window=20, pass_words=pass_words)
    found = C.leaks(make_docs(rows), bench, p).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in found} == {(1, 1, "near")}


def pairs_of(docs, items, p):
    """(doc, item) of the matches in one segment of documents and items given as lists of numbers."""
    g = C.Segment.build(list(range(len(docs))), [np.array(d, np.uint64) for d in docs])
    freq = {w: sum(d.count(w) for d in docs) for w in {w for x in items for w in x}}
    t = C.make_tests([(i, np.array(x, np.uint64)) for i, x in enumerate(items)], freq, p)
    return {(m[0], m[1]) for m in C.search(g, t, p)}


@pytest.mark.parametrize("size", [13, 14, 15])
@pytest.mark.parametrize("edited", [0, 6, 12])
def test_near_matches_beside_a_phrase_of_another_document(size, edited):
    item = list(range(size))
    copy = [99 if w == edited else w for w in item]
    far = list(range(200, 230))
    assert pairs_of([item, copy, far], [item], C.DecontaminationParams()) == {(0, 0), (1, 0)}
    assert pairs_of([copy, item, far], [item], C.DecontaminationParams()) == {(0, 0), (1, 0)}
    assert pairs_of([far + item, copy + far], [item], C.DecontaminationParams()) == {(0, 0), (1, 0)}


@pytest.mark.parametrize("passage", [list(range(1, 13)), [0, *range(2, 13)], list(range(12))])
@pytest.mark.parametrize("lead", [[], [300, 301], list(range(300, 330))])
@pytest.mark.parametrize("before", [[], [[500]], [list(range(400, 440))]])
def test_cut_passages_anywhere(passage, lead, before):
    """The first or last words of an item may be missing wherever the passage lies in its document, and beside whatever document."""
    p = C.DecontaminationParams()
    item, tail = list(range(13)), list(range(600, 620))
    at = len(before)
    for end in ([], [700, 701], tail):
        assert pairs_of([*before, lead + passage + end, tail], [item], p) == {(at, 0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), max_size=12), min_size=1, max_size=5), st.lists(st.lists(st.integers(0, 8), min_size=3, max_size=8), min_size=1, max_size=3))
def test_neighbours_make_no_difference(docs, items):
    p = C.DecontaminationParams(window=5, least_words=3, slack=1, near_share=0.6)
    items = [(i, np.array(x, np.uint64)) for i, x in enumerate(items)]
    t = C.make_tests(items, {w: sum(d.count(w) for d in docs) for w in range(9)}, p)
    build = lambda d: C.Segment.build([k for k, _ in d], [np.array(x, np.uint64) for _, x in d])
    together = C.search(build(list(enumerate(docs))), t, p)
    alone = [m for k, d in enumerate(docs) for m in C.search(build([(k, d)]), t, p)]
    assert {m[:3] for m in together} == {m[:3] for m in alone}
    assert all(0 <= m[5] < m[6] <= len(docs[m[0]]) for m in together)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), max_size=14), min_size=1, max_size=4), st.lists(st.lists(st.integers(0, 11), min_size=3, max_size=9), min_size=1, max_size=3), st.sampled_from([(6, 1, 0.53), (6, 2, 0.61), (4, 0, 0.71), (9, 3, 0.83)]))
def test_near_matches_against_brute_force(docs, items, setting):
    """Every place of every window in every document is tried; the words found there must weigh enough."""
    p = C.DecontaminationParams(window=setting[0], least_words=3, slack=setting[1], near_share=setting[2])
    t = C.make_tests([(i, np.array(x, np.uint64)) for i, x in enumerate(items)], {w: sum(d.count(w) for d in docs) for w in {w for x in items for w in x}}, p)
    expected = set()
    for s, n, k, ranked in zip(t.start.tolist(), t.width.tolist(), t.item.tolist(), t.ranked.tolist(), strict=True):
        limit = (1 - p.near_share) * sum((t.weight[s + o] for o in ranked[:n]), 0.0)
        for d, doc in enumerate(docs):
            for at in range(-n - p.slack, len(doc) + p.slack):
                missing = sum((t.weight[s + o] for o in ranked[:n] if int(t.words[s + o]) not in doc[max(0, at + o - p.slack) : max(0, at + o + p.slack + 1)]), 0.0)
                if missing <= limit:
                    expected.add((d, int(t.items[k])))
    assert pairs_of(docs, items, p) == expected


def test_two_rarest_words_altered():
    item = list(range(13))
    for a, b in ((0, 1), (3, 9), (11, 12)):
        copy = [99 if w in (a, b) else w for w in item]
        assert pairs_of([list(range(200, 230)), copy, item[2:]], [item], C.DecontaminationParams()) == {(1, 0), (2, 0)}


def test_empty_tables(spark, make_docs, no_docs, odd_docs):
    none = spark.createDataFrame([], BENCH)
    one = spark.createDataFrame([(1, prose(5, 30), "")], BENCH)
    assert C.leaks(no_docs, one).count() == 0
    assert C.leaks(odd_docs, none).count() == 0
    assert C.reject(odd_docs, one).count() == odd_docs.count()
