import random
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tomewright.llm import ngram_join as N

from .conftest import prose


def grams(text, n):
    for _, g in N._sets([text], n):
        return set(g.tolist())
    return set()


def brute(rows, p):
    out = {}
    sets = [(d, grams(t, p.n)) for d, t in rows if d is not None and t]
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y and (j := len(x & y) / len(x | y)) >= p.threshold:
            k = (min(a, b), max(a, b))
            out[k] = max(j, out.get(k, 0))
    return out


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join("new" + str(r.random())[2:6] if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def rows():
    rows = [(i, prose(i, 100)) for i in range(60)]
    for g in range(12):
        for k in range(1 + g):
            rows.append((1000 + g * 50 + k, edited(prose(g, 100), 0.03 + 0.01 * (k % 8), g * 100 + k)))
    rows += [(2000 + i, prose(0, 100)) for i in range(30)]  # equal texts
    rows += [(3000, None), (3001, ""), (3002, "..."), (3003, "one two"), (3004, "One, two!"), (None, prose(0, 100)), (2000, prose(0, 100)), (3005, prose(7, 20_000)), (3006, prose(7, 20_000) + " end")]
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_pairs_against_brute_force(make_docs, rows, block):
    p = N.JoinParams(block=block)
    got = N.similar_pairs(make_docs(rows, extra=True), p).collect()
    found, truth = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in got}, brute(rows, p)
    assert len(found) == len(got)
    assert set(found) <= set(truth)
    assert len(found) >= 0.95 * len(truth)
    assert all(found[k] == pytest.approx(truth[k]) for k in found)
    assert (3003, 3004) in found and (3005, 3006) in found


def clusters(units, pairs):
    parent = {u: u for u in units}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {u: root(u) for u in units}


def unit_pairs(rows, p):
    """Rows (id, set) without repeats, and the pairs of them that reach the threshold."""
    units = sorted({(d, tuple(sorted(g))) for d, t in rows if t and (g := grams(t, p.n))}, key=lambda u: (u[0] is None, u[0] or 0, u[1]))
    sets = [set(g) for _, g in units]
    return units, [(i, j) for i, j in combinations(range(len(units)), 2) if 2 * min(len(sets[i]), len(sets[j])) >= max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= p.threshold]


@pytest.mark.parametrize("block", [256, 4])
def test_linked_against_brute_force(make_docs, rows, block):
    p = N.JoinParams(block=block, recall=0.9999, max_hashes=1024)
    named = [(d, t) for d, t in rows if d is not None] + [(7, prose(3, 100)), (3003, "other words")]
    got = N.linked(make_docs([*named, (None, prose(0, 100))], extra=True), p).collect()
    units, pairs = unit_pairs(named, p)
    group, n = clusters(range(len(units)), pairs), [0] * len(units)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    least = {}
    for i in range(len(units)):
        least[group[i]] = min(least.get(group[i], units[i][0]), units[i][0])
    want = sorted((units[i][0], least[group[i]], n[i]) for i in range(len(units)) if n[i])
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_keep_one(make_docs, rows, no_docs, odd_docs):
    p = N.JoinParams(recall=0.9999, max_hashes=1024)
    docs = make_docs(rows, extra=True)
    units, pairs = unit_pairs(rows, p)
    group = clusters(range(len(units)), pairs)
    kept = N.keep_one(docs, p)
    assert kept.columns == docs.columns
    want = [units[i][0] for i in range(len(units)) if group[i] == i] + [3000, 3001, 3002]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert N.keep_one(no_docs).count() == 0 and N.similar_pairs(no_docs).count() == 0 and N.linked(no_docs).count() == 0
    assert sorted(str(r["doc_id"]) for r in N.keep_one(odd_docs).collect()) == ["1", "3", "4", "5", "6", "7", "8", "None", "None"]


def test_keep_one_with_one_id_for_two_texts(make_docs):
    x, y = prose(1, 60), prose(2, 60)
    docs = make_docs([(7, x), (1, x), (2, x), (7, y), (8, y), (9, y), (None, y), (5, prose(3, 60)), (5, prose(4, 60)), (None, prose(6, 60)), (None, prose(6, 60))])
    assert sorted((str(r["doc_id"]), r["text"]) for r in N.keep_one(docs).collect()) == sorted([("1", x), ("7", y), ("5", prose(3, 60)), ("5", prose(4, 60)), ("None", prose(6, 60))])


def test_keep_one_ties_and_clashing_names(spark, make_docs):
    docs = make_docs([(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50))]).selectExpr("*", "monotonically_increasing_id() AS gone_id", "'y' AS gone_version", "1 AS row", "map('a', 1) AS m", "'z' AS _gone", "0 AS `a.b`")
    one, two = (sorted(str(r) for r in N.keep_one(docs.repartition(n)).collect()) for n in (1, 3))
    assert len(one) == 2 and len(two) == 2
    assert N.keep_one(docs).columns == docs.columns


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_bands():
    for recall in (0.9, 0.95, 0.99):
        bands, rows = N.choose_bands(N.JoinParams(recall=recall))
        assert N.recall_at(0.5, bands, rows) >= recall and bands * rows <= 256
    with pytest.raises(ValueError):
        N.choose_bands(N.JoinParams(threshold=0.01, recall=0.99, max_hashes=2))
