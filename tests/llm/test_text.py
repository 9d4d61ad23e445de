import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tomewright.llm.text import RunHash, Words, chunks, gram_hashes


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words(texts):
    w = Words(texts)
    seen = {}
    for i, t in enumerate(texts):
        raw = (t or "").lower().encode("utf-8", "replace")
        expected = re.findall(rb"[0-9a-z\x80-\xff]+", raw)
        own = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()
        assert len(own) == len(expected)
        for h, word in zip(own, expected, strict=True):
            assert seen.setdefault(h, word) == word
    by_word = {}
    for h, word in seen.items():
        assert by_word.setdefault(word, h) == h


@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 5))
def test_runs(values, n):
    x = np.array(values, np.uint64)
    a = gram_hashes(x, n)
    runs = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    assert len(a) == len(runs) and len(set(a.tolist())) == len(set(runs))
    starts = np.arange(len(runs))
    b = RunHash(x).of(starts, starts + n)
    assert len(set(b.tolist())) == len(set(runs))


@given(st.lists(st.integers(0, 50), max_size=20))
def test_chunks(sizes):
    got = list(chunks(sizes, 60))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 60 or b - a == 1 for a, b in got)
