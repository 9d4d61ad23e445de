import random

import numpy as np
import pytest
import regex

from tomewright.llm import quality as Q

from .conftest import prose


def brute(patterns, counts, p):
    """The same steps, one document at a time."""
    votes = [[{"-": -1, "0": 0, "+": 1}[c] for c in x] for x, n in zip(patterns, counts, strict=True) for _ in range(n)]
    rules = len(patterns[0])
    n_voting = [sum(v[r] != 0 for v in votes) for r in range(rules)]
    table = [[p.against_bad] * rules, [p.against_good] * rules]
    prior, last = p.prior, -np.inf
    for _ in range(p.rounds):
        post, like = [], 0.0
        for v in votes:
            w = []
            for c, share in ((0, 1 - prior), (1, prior)):
                x = share
                for r in range(rules):
                    x *= table[c][r] if v[r] < 0 else 1 - table[c][r] if v[r] > 0 else 1
                w.append(x)
            post.append(w[1] / sum(w))
            like += np.log(sum(w))
        for c, b in ((0, p.against_bad), (1, p.against_good)):
            for r in range(rules):
                like += (p.belief * n_voting[r] + 1) * (b * np.log(table[c][r]) + (1 - b) * np.log(1 - table[c][r]))
        if like / len(votes) - last < p.tolerance:
            break
        last = like / len(votes)
        for c, b in ((0, p.against_bad), (1, p.against_good)):
            for r in range(rules):
                q = [x if c else 1 - x for x in post]
                no = sum(x for x, v in zip(q, votes, strict=True) if v[r] < 0)
                yes = sum(x for x, v in zip(q, votes, strict=True) if v[r] > 0)
                s = p.belief * n_voting[r] + 1
                table[c][r] = min(max((no + s * b) / (no + yes + s), 1e-6), 1 - 1e-6)
        prior = min(max(sum(post) / len(votes), 0.02), 0.98)
    at, out = 0, []
    for n in counts:
        out.append(post[at])
        at += n
    return out


def test_against_brute_force():
    patterns, counts = ["+++", "++0", "--+", "-00", "0-+", "000"], [30, 9, 6, 3, 2, 1]
    p = Q.QualityParams(rounds=40)
    got, table, prior = Q.estimate(patterns, counts, p)
    assert got == pytest.approx(brute(patterns, counts, p), abs=1e-9)
    assert (table[0] >= table[1]).all() and 0 < prior < 1


def test_nothing():
    assert len(Q.estimate([], [], Q.QualityParams())[0]) == 0


def test_bad_documents_go(make_docs):
    good = [(i, "\n".join(prose(i * 9 + k, 30).capitalize() + "." for k in range(3))) for i in range(60)]
    bad = [(100 + i, " ".join(w + "###" for w in prose(i, 80).split())) for i in range(6)] + [(110 + i, prose(i, 60).upper()) for i in range(4)]
    kept = {r["doc_id"] for r in Q.keep(make_docs(good + bad)).collect()}
    assert kept == {i for i, _ in good}


def test_odd_rows(odd_docs, no_docs):
    rows = Q.score(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["votes"] for r in rows if r["doc_id"] in (1, 3)} == {"-00000000"}
    same = [r["p_quality"] for r in rows if r["doc_id"] in (6, 9)]
    assert len(same) == 3 and len(set(same)) == 1
    assert Q.keep(odd_docs).columns == ["doc_id", "votes", "p_quality"]
    assert Q.keep(no_docs).count() == 0


def votes_by_hand(text):
    t = text or ""
    words = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" ")]
    spaced = {w for w in t.split(" ") if w}
    n, size, few = len(words), len(t), len(words) < 8
    marked = sum(bool(regex.search(r"[^\p{L}\p{N}.,;:!?'\"()\-]$|!!$", w)) for w in words)
    ended = sum(x.rstrip(" ")[-1:] in tuple(".!?") for x in lines)
    of = lambda chars: sum(c in chars for c in t)
    symbols, upper, bars = of("#$%&*!|<>{}\\^~"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("|\t")
    rules = [
        (n >= 20, n < 1),
        (size and symbols * 200 <= size, size and symbols * 33 > size),
        (not few and marked * 20 <= n, not few and marked * 4 > n),
        (not few and n * 4 <= size <= n * 9, size and not few and (size > n * 13 or size < n * 3)),
        (size and upper * 12 <= size, size and upper * 4 > size),
        (size and ended * 2 > len(lines) and not few, size and ended * 4 < len(lines) and not few),
        (len(lines) >= 4 and len(set(lines)) * 20 >= len(lines) * 19, len(lines) >= 4 and len(set(lines)) * 10 < len(lines) * 7),
        (n >= 30 and len(spaced) * 5 > n, n >= 30 and len(spaced) * 10 < n),
        (size and bars * 50 < n, size and not few and bars * 4 > n),
    ]
    return "".join("-" if bad else "+" if good else "0" for good, bad in rules)


def test_votes_against_brute_force(make_docs):
    r = random.Random(2)
    pieces = [*prose(1, 30).split(), "WORD", "###", "a|b", "|", "\t", "\n", "\n", "!!", "so.", "yes!", "(x)", "é", "ab-", "1234567890123456789", " ", "  ", "x"]
    texts = [" ".join(r.choice(pieces[r.randrange(len(pieces)) :]) for _ in range(r.randrange(0, 90))) for _ in range(600)] + [None, "", "\n\n", prose(2, 30_000), ("line one.\n" * 9)]
    got = {x["doc_id"]: x["votes"] for x in Q.votes(make_docs(list(enumerate(texts)), extra=True)).collect()}
    assert got == {i: votes_by_hand(t) for i, t in enumerate(texts)}
