from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tomewright.llm import packing as P
from tomewright.llm.tokenizer import encode

from .conftest import prose


def brute(sizes, window, most):
    """The rule as written: best fit, else the fullest window goes."""
    rooms, out, number = {}, [], 0
    for doc, n in enumerate(sizes):
        whole = n // window * window
        for a in range(0, whole, window):
            out.append((number, doc, a, a + window, 0))
            number += 1
        rest = n - whole
        if not rest:
            continue
        fits = [(room, w) for w, room in rooms.items() if room >= rest]
        if fits:
            room, w = min(fits)
        else:
            if len(rooms) == most:
                del rooms[min((r, w) for w, r in rooms.items())[1]]
            room, w = window, number
            number += 1
        out.append((w, doc, whole, n, window - room))
        rooms[w] = room - rest
        if not rooms[w]:
            del rooms[w]
    return out


@settings(max_examples=100)
@given(st.lists(st.integers(1, 45), max_size=60), st.integers(1, 5))
def test_against_brute_force(sizes, most):
    w, got = P.OpenWindows(20, most, 0), []
    for doc, n in enumerate(sizes):
        got += w.add(doc, n)
        assert len(w.pieces) <= most
    assert sorted(got + w.left()) == sorted(brute(sizes, 20, most))


@settings(max_examples=100)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_merging(fills):
    out = P.merge_leftovers(list(enumerate(fills)), 20)
    held = defaultdict(int)
    for window, target, shift in out:
        assert shift == held[target] and window >= 0
        held[target] += fills[window]
    assert sorted(w for w, _, _ in out) == list(range(len(fills)))
    assert all(x <= 20 for x in held.values())
    light = [x for x in held.values() if x <= 10]
    assert len(light) <= 1


def test_documents(make_docs, odd_docs, no_docs):
    for docs in (odd_docs, make_docs([(i, prose(i, 20 + i * 7 % 400)) for i in range(120)]).repartition(6)):
        for p in (P.PackingParams(), P.PackingParams(window=64, open_windows=3, merge_group=2)):
            check(docs, P.pack_documents(docs, p).collect(), p)
    assert P.pack_documents(no_docs).count() == 0


def check(docs, rows, p):
    windows, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 <= r["doc_from"] < r["doc_to"]
        windows[r["window_id"]].append((r["at"], r["at"] + r["doc_to"] - r["doc_from"]))
        parts[r["doc_id"]].append((r["doc_from"], r["doc_to"]))
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= p.window
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    expected = defaultdict(int)
    for d in docs.collect():
        n = len(encode(d["text"], p.tokenizer))
        if d["text"]:
            expected[d["doc_id"]] += n + 1
    assert {d: sum(b - a for a, b in x) for d, x in parts.items()} == dict(expected)


def test_windows_hold_the_tokens(make_docs):
    """The rows alone give every window's tokens, and the pieces of a document together its text's."""
    docs = make_docs([(i, prose(i, 5 + i * 37 % 300)) for i in range(60)] + [(100, None), (101, ""), (None, "no id")]).repartition(3)
    for p in (P.PackingParams(), P.PackingParams(window=64, open_windows=3, merge_group=2), P.PackingParams(window=64, frame_tokens=100)):
        rows = P.pack_documents(docs, p).collect()
        assert all(len(r["tokens"]) == r["doc_to"] - r["doc_from"] for r in rows)
        for d in docs.collect():
            own = [x for r in sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["doc_from"]) for x in r["tokens"]]
            assert own == ([*encode(d["text"], p.tokenizer).tolist(), p.tokenizer.separator] if d["text"] else [])
