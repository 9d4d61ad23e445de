import random

import numpy as np
import pandas as pd
import pytest

from tomewright.llm import toxicity as T

from .conftest import prose

BAD = "vilewort grubling scornish".split()
P = T.ToxicityParams(epochs=8, min_positives=8)


def toxic(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(BAD) if r.random() < 0.06 else w for w in prose(seed, n).split()) + " " + r.choice(BAD)


@pytest.fixture(scope="module")
def corpus(spark, make_docs):
    rows = [(i, toxic(i, 60 + i % 90) if i % 4 == 0 else prose(i, 60 + i % 90), "en" if i % 2 else "de") for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (5, None, None), (0, 1, 1)], "doc_id bigint, quality int, toxic int")
    return rows, make_docs(rows, extra=True), labels


def test_held_out_accuracy(corpus):
    rows, docs, labels = corpus
    flagged = {r["doc_id"] for r in T.flag(docs, labels, P).collect()}
    new = range(600, 900)
    caught = sum(i in flagged for i in new if i % 4 == 0)
    wrong = sum(i in flagged for i in new if i % 4)
    assert caught >= 0.9 * 75 and wrong <= 5


def test_reject_is_the_complement(corpus):
    rows, docs, labels = corpus
    kept = T.reject(docs, labels, P)
    assert kept.columns == docs.columns
    gone = {r["doc_id"] for r in T.flag(docs, labels, P).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, *_ in rows if i not in gone]


def test_rows_without_id_are_judged_by_their_text(corpus, make_docs):
    rows, docs, labels = corpus
    odd = make_docs([(None, toxic(5000 + 4 * i, 120), "en") for i in range(20)] + [(None, prose(6000 + i, 120), "en") for i in range(20)] + [(None, None), (None, "")], extra=True)
    kept = T.reject(docs.unionByName(odd), labels, P).where("doc_id IS NULL").collect()
    flagged = T.flag(docs.unionByName(odd), labels, P).where("doc_id IS NULL").count()
    assert flagged >= 18 and len(kept) == 42 - flagged
    assert {None, ""} <= {r["text"] for r in kept}


def test_odd_rows(corpus, odd_docs, no_docs, spark):
    _, docs, labels = corpus
    model = T.model_for(docs, labels, P)
    rows = T.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["toxicity"] == 0 for r in rows if r["doc_id"] in (1, 3, 4))
    assert len({r["toxicity"] for r in rows if r["doc_id"] in (6, 9)}) == 1
    assert T.score(no_docs, model).count() == 0
    none = labels.limit(0)
    assert T.flag(docs, none).count() == 0 and T.reject(odd_docs, none).count() == odd_docs.count()
    assert T.flag(no_docs, labels).count() == 0
    assert T.reject(odd_docs, labels.where("toxic = 0")).count() == odd_docs.count()


def test_gradients_match_differences():
    p = T.ToxicityParams(buckets=64, dim=3, filters=2)
    rng = np.random.default_rng(0)
    texts, y = [prose(i, 12 + i) for i in range(4)], np.array([0, 1, 0, 1])
    w = {k: v.astype(np.float64) for k, v in T._initial(texts, y, p, rng).items()}
    ids, bounds = T._encode(texts, p)

    def loss():
        z = T._forward(ids, bounds, w, p)[-1]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    done = T._forward(ids, bounds, w, p)
    grads, rows = T._gradients(done, ids, w, (1 / (1 + np.exp(-done[-1])) - y) / len(y), p)
    table = np.zeros_like(w["e"])
    table[rows] = grads["e"]
    grads["e"] = table
    for name, at in (("v", (1,)), ("c", (0,)), ("w2", (1, 2, 0)), ("b3", (1,)), ("e", (int(ids[0, 3]), 1)), ("e", (int(ids[2, 5]), 2))):
        old = w[name][at]
        w[name][at] = old + 1e-5
        up = loss()
        w[name][at] = old - 1e-5
        down = loss()
        w[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_padding_does_not_leak_between_documents():
    p = T.ToxicityParams()
    rng = np.random.default_rng(1)
    texts = [prose(i, 5 + 7 * i) for i in range(8)]
    w = T._initial(texts, np.arange(8) % 2, p, rng)
    together, alone = T.logits(texts, w, p), [T.logits([t], w, p)[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-5)


def test_a_toxic_passage_counts_in_a_long_text(corpus):
    """Max pooling: a passage of 100 words is found alone and among 20,000 clean words."""
    _, docs, labels = corpus
    m = T.model_for(docs, labels, P)
    share = lambda texts: float(np.mean([m.scale[0] * x + m.scale[1] > np.log(m.threshold("en") / (1 - m.threshold("en"))) for x in T.logits(texts, m.weights, P)]))
    clean = [prose(7000 + i, 20_000) for i in range(10)]
    passages = [toxic(8000 + i, 100) for i in range(10)]
    assert share(passages) >= 0.9 and share(clean) <= 0.1
    assert share([f"{c[: len(c) // 3]} {t} {c[len(c) // 3 :]}" for c, t in zip(clean, passages, strict=True)]) >= 0.9


def test_the_sample_is_bounded_by_its_texts(corpus):
    rows, docs, labels = corpus
    whole = T.labelled_sample(docs, labels, P)
    part = T.labelled_sample(docs, labels, T.ToxicityParams(max_chars=100_000))
    assert len(whole) == 600 and part["text"].str.len().sum() <= 100_000 and set(part["toxic"]) == {0, 1}
    assert set(part["text"]) <= {r[1] for r in rows}


def test_threshold_of_languages():
    s, y = np.array([0.9, 0.6, 0.55, 0.1]), np.array([1, 1, 0, 0])
    assert 0.55 < T.best_threshold(s, y, np.ones(4)) < 0.6
    m = T.ToxicityModel(P, None, thresholds={"*": 0.5, "de": 0.6})
    assert (m.threshold("de"), m.threshold("xx"), m.threshold(None)) == (0.6, 0.5, 0.5)


def test_every_labelled_document_is_fitted(corpus, spark):
    """Bounds of the sample don't matter to a model; in many shards, counts and the table cover all documents."""
    rows, docs, labels = corpus
    a, b = (T.model_for(docs, labels, T.ToxicityParams(epochs=2, shard=60, max_labelled=n, max_chars=c)) for n, c in ((10, 20_000), (5000, 60_000_000)))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights) and (a.scale, a.thresholds) == (b.scale, b.thresholds)
    table = {r["_id"]: r for r in T.labelled(docs, labels, P).collect()}
    assert sorted(table) == list(range(600)) and all(r["toxic"] == (i % 4 == 0) and r["text"] == rows[i][1] for i, r in table.items())
    seen = T._presence([r["text"] for r in table.values() if not r["held"]], np.array([r["toxic"] for r in table.values() if not r["held"]]), P)
    assert np.array_equal(a.weights["e"].any(axis=1), seen.any(axis=1))
    flagged = {r["doc_id"] for r in T.flag(docs, labels, T.ToxicityParams(epochs=8, shard=60)).collect()}
    assert sum(i in flagged for i in range(600, 900, 4)) >= 0.9 * 75 and sum(i in flagged for i in range(600, 900) if i % 4) <= 5


def test_counts_of_shards_are_added_exactly(spark):
    parts = [np.random.default_rng(i).normal(size=(T.BLOCK + 9, 3)).astype(np.float32) for i in range(4)]
    at = [np.flatnonzero(np.random.default_rng(9 + i).random(T.BLOCK + 9) < 0.3) for i in range(4)]
    pdf = pd.concat([x for a, p in zip(at, parts, strict=True) for x in T._changes(a, p[a])], ignore_index=True)
    sums, times = np.zeros((T.BLOCK + 9, 3)), np.zeros(T.BLOCK + 9)
    for a, p in zip(at, parts, strict=True):
        sums[a] += p[a]
        times[a] += 1
    changes = spark.createDataFrame(pdf, "block int, at binary, change binary")
    assert T._added(changes, sums.shape, mean=False) == pytest.approx(sums, abs=1e-8)
    assert T._added(changes, sums.shape, mean=True) == pytest.approx(sums / np.maximum(times, 1)[:, None], abs=1e-6)


def test_thresholds_equal_those_of_all_scores_at_once(spark):
    r = np.random.default_rng(3)
    rows = [(("de", "en", "fr", "", None)[i % 5], int(y), float(np.round(np.clip(0.3 * y + r.random() * 0.7, 0, 1), 2))) for i, y in enumerate(r.random(1500) < 0.3)]
    rows += [("es", int(i < 7), i / 40) for i in range(40)]
    got = T.fitted_thresholds(spark.createDataFrame(rows, "lang string, toxic int, score double").repartition(7), P)
    best = lambda own: T.best_threshold(np.array([x[2] for x in own]), np.array([x[1] for x in own]), np.ones(len(own)))
    assert got == {"*": best(rows)} | {k: best([x for x in rows if x[0] == k]) for k in ("de", "en", "fr")}
