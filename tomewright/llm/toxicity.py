"""Toxicity: convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the rows of its own hash and of the hashes of its
first 4 and 6 bytes. Filters of several widths run over the words of a document and are
max-pooled over the whole document, so a toxic passage counts alike wherever it stands
and however long the text around it is. Training is numpy in Spark's tasks (Adam; of the table only
the rows that a batch touches move); rows that training never saw are zero, so unknown
words can't raise a maximum, and no maximum has a negative weight, so no text that
is added to a toxic passage lowers its score. Scores are calibrated on held-out documents, and the
threshold of each language is the one of the best F1 there; a language of fewer than
`min_positives` held-out toxic documents has the threshold over all languages.

Every labelled document counts, however many there are: the share `held_out` of them, by hash,
gives calibration and thresholds, all others the model. These lie in shards of about `shard`
documents. In each epoch every shard trains from the common weights; what it changed is
averaged over the shards that changed the same row. Counts of words by class, sums of
the calibration and F1 are taken over whole tables; the driver gets only what has the size of
the model, and two to four bytes a labelled id.

Defined results: null or empty text scores 0 and is never flagged; a null or
unknown language uses the threshold over all languages; without labelled rows of
both classes nothing is flagged; labels of a null document or null class are
ignored; a document labelled both ways is toxic; of several texts of one labelled
doc_id the least is fitted; repeated rows are scored alike; a score equal to its
threshold is not flagged; an empty table gives an empty result; other columns are not
touched, whatever their names; a null doc_id is judged by its text like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .text import Words, chunks, lean, mix, trim


BLOCK = 1 << 14  # rows of a table that travel together
SCALE = float(1 << 32)  # changes are added as integers, so that their order doesn't matter


@dataclass(frozen=True)
class ToxicityParams:
    """max_labelled and max_chars bound labelled_sample (rows of each class, characters together) and nothing else:
    models are fitted to all labelled rows. shard: about so many of them are trained on by one task."""

    max_labelled: int = 5000
    max_chars: int = 60_000_000
    buckets: int = 1 << 17
    dim: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    prefixes: tuple[int, ...] = (4, 6)
    epochs: int = 5
    batch: int = 48
    rate: float = 0.01
    held_out: float = 0.3
    shard: int = 10_000
    min_positives: int = 12
    seed: int = 7


@dataclass
class ToxicityModel:
    params: ToxicityParams
    weights: dict[str, np.ndarray] | None
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("*", 2.0))


def _encode(texts: list[str | None], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (all hashes have a range of their own in it); words of each text."""
    w = Words(texts)
    hashes = [w.hashes] + [mix(w.hash_of(w.first, np.minimum(w.first + n, w.last))) for n in p.prefixes]
    return np.stack([(h % np.uint64(p.buckets)).astype(np.int32) + k * p.buckets for k, h in enumerate(hashes)]), w.bounds


def _responses(x: np.ndarray, end: np.ndarray, weights: dict, widths: tuple[int, ...]) -> np.ndarray:
    """Filter outputs at every word; places past the end of the document are zeros."""
    out, index = [], np.arange(len(x))
    for k in widths:
        r = x @ weights[f"w{k}"][0]
        for j in range(1, k):
            y = x[j:] @ weights[f"w{k}"][j]
            y[index[j:] >= end[: len(x) - j]] = 0
            r[: len(x) - j] += y
        out.append(r + weights[f"b{k}"])
    return np.concatenate(out, axis=1)


def _forward(ids: np.ndarray, bounds: np.ndarray, weights: dict, p: ToxicityParams):
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return None
    starts, end = bounds[:-1][full], np.repeat(bounds[1:][full], sizes[full])
    x = weights["e"][ids[0]]
    for k in range(1, len(ids)):
        x += weights["e"][ids[k]]
    r = _responses(x, end, weights, p.widths)
    top = np.maximum.reduceat(r, starts, axis=0)
    logit = np.maximum(top, 0) @ weights["v"] + weights["c"][0]
    return full, starts, end, x, r, top, logit


def logits(texts: list[str | None], weights: dict, p: ToxicityParams) -> np.ndarray:
    """One logit a text; -inf where there is no word."""
    out = np.full(len(texts), -np.inf, np.float64)
    for a, b in chunks([len(t or "") for t in texts], 1_000_000):
        done = _forward(*_encode(texts[a:b], p), weights, p)
        if done:
            out[a + done[0]] = done[-1]
    return out


def _presence(texts: list[str | None], y: np.ndarray, p: ToxicityParams) -> np.ndarray:
    """In how many texts of class 0 and of class 1 each row of the embedding table is used."""
    present = np.zeros((p.buckets * (1 + len(p.prefixes)), 2))
    for t, cls in zip(texts, y, strict=True):
        present[np.unique(_encode([t], p)[0]), cls] += 1
    return present


def _initial(texts: list[str], y: np.ndarray, p: ToxicityParams, rng: np.random.Generator) -> dict[str, np.ndarray]:
    return _first_weights(_presence(texts, y, p), np.bincount(y, minlength=2), p, rng)


def _first_weights(present: np.ndarray, totals: np.ndarray, p: ToxicityParams, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random weights, but the first embedding axis starts at the log odds of the bucket."""
    weights: dict[str, np.ndarray] = {}
    seen, rate = present.sum(1) > 0, (present + 1.0) / (totals + 2.0)
    odds = np.where(seen, np.log(rate[:, 1] / rate[:, 0]), 0.0)
    table = rng.normal(0, 0.05, (len(present), p.dim))
    table[:, 0] += 0.3 * np.clip(odds - np.median(odds[seen]) if seen.any() else odds, -3, 3)
    weights["e"] = np.where(seen[:, None], table, 0).astype(np.float32)
    for k in p.widths:
        w = rng.normal(0, 0.3, (k, p.dim, p.filters))
        w[:, 0, : p.filters // 2] = np.abs(w[:, 0, : p.filters // 2]) + 0.5
        weights[f"w{k}"] = w.astype(np.float32)
        weights[f"b{k}"] = np.zeros(p.filters, np.float32)
    n = p.filters * len(p.widths)
    weights["v"], weights["c"] = np.abs(rng.normal(0, 0.1, n)).astype(np.float32), np.zeros(1, np.float32)
    return weights


def _gradients(done, ids, weights, error: np.ndarray, p: ToxicityParams) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients, that of the table for the rows in the second value alone."""
    full, starts, end, x, r, top, _ = done
    grads = {"v": np.maximum(top, 0).T @ error, "c": np.array([error.sum()], np.float32)}
    to_top = error[:, None] * weights["v"][None] * (top > 0)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    best = r == top[of]
    words, parts = [], []
    for n, k in enumerate(p.widths):
        gw, gb = np.zeros_like(weights[f"w{k}"]), np.zeros(p.filters, np.float32)
        for f in range(p.filters):
            c = n * p.filters + f
            at = np.flatnonzero(best[:, c])
            place = np.zeros(len(starts), np.int64)
            place[of[at][::-1]] = at[::-1]
            g = to_top[:, c]
            gb[f] = g.sum()
            for j in range(k):
                ok = (place + j < end[place]) & (g != 0)
                q = place[ok] + j
                gw[j, :, f] = x[q].T @ g[ok]
                words.append(q)
                parts.append(g[ok, None] * weights[f"w{k}"][j, :, f])
        grads[f"w{k}"], grads[f"b{k}"] = gw, gb
    touched, part = ids[:, np.concatenate(words)], np.concatenate(parts)
    rows, place = np.unique(touched, return_inverse=True)
    grads["e"] = np.zeros((len(rows), p.dim), weights["e"].dtype)
    for own in place.reshape(touched.shape):
        np.add.at(grads["e"], own, part)
    return grads, rows


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as one table: the embeddings, and below them the others in rows as wide."""
    small = np.concatenate([weights[k].ravel() for k in sorted(weights) if k != "e"])
    dim = weights["e"].shape[1]
    return np.concatenate([weights["e"], np.pad(small, (0, -len(small) % dim)).reshape(-1, dim)])


def _unflat(table: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = len(like["e"])
    weights, small, at = {"e": table[:n]}, table[n:].ravel(), 0
    for k in sorted(like):
        if k != "e":
            weights[k] = small[at : at + like[k].size].reshape(like[k].shape)
            at += like[k].size
    return weights


def train(batches: Iterator[tuple[list[str], np.ndarray]], weights: dict[str, np.ndarray], totals: np.ndarray, p: ToxicityParams, seed: int) -> np.ndarray:
    """One pass over texts and classes, changes weights; whether each row of the embedding table was used.
    totals: documents of class 0 and of class 1 in all."""
    rng = np.random.default_rng([p.seed, seed])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    class_weight, used, step = 0.5 * totals.sum() / totals, np.zeros(len(weights["e"]), bool), 0
    for texts, y in batches:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), p.batch):
            part = order[at : at + p.batch]
            ids, bounds = _encode([texts[i] for i in part], p)
            done = _forward(ids, bounds, weights, p)
            if not done:
                continue
            t = y[part][done[0]]
            error = ((1 / (1 + np.exp(-np.clip(done[-1], -30, 30))) - t) * class_weight[t] / len(t)).astype(np.float32)
            step += 1
            grads, rows = _gradients(done, ids, weights, error, p)
            used[rows] = True
            for k, g in grads.items():
                own = rows if k == "e" else slice(None)
                m, v = (x[own] for x in moments[k])
                m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
                moments[k][0][own], moments[k][1][own] = m, v
                weights[k][own] -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            np.maximum(weights["v"], 0, out=weights["v"])
    return used


def _changes(at: np.ndarray, values: np.ndarray) -> Iterator[pd.DataFrame]:
    """What is to be added to the rows `at` (ascending) of a table, by blocks of the table."""
    blocks, first = np.unique(at // BLOCK, return_index=True)
    for block, a, b in zip(blocks, first, np.append(first[1:], len(at)), strict=True):
        yield pd.DataFrame({"block": [block], "at": [at[a:b].astype(np.int32).tobytes()], "change": [values[a:b].astype(np.float32).tobytes()]})


def _added(changes: DataFrame, shape: tuple[int, int], mean: bool) -> np.ndarray:
    """The changes of all shards together: their sums, or means over the shards that changed a row."""
    kind = np.float32 if mean else np.float64

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        times: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, at, change in zip(pdf["block"], pdf["at"], pdf["change"], strict=True):
                if block not in sums:
                    sums[block], times[block] = np.zeros((BLOCK, shape[1]), np.int64), np.zeros(BLOCK, np.int64)
                rows = np.frombuffer(at, np.int32) % BLOCK
                sums[block][rows] += np.rint(np.frombuffer(change, np.float32).astype(np.float64) * SCALE).astype(np.int64).reshape(-1, shape[1])
                times[block][rows] += 1
        for block, total in sums.items():
            by = np.maximum(times[block], 1)[:, None] if mean else 1
            yield pd.DataFrame({"block": [block], "value": [(total / SCALE / by).astype(kind).tobytes()]})

    out = np.zeros((-(-shape[0] // BLOCK) * BLOCK, shape[1]), kind)
    for row in changes.repartition("block").mapInPandas(lean(add), "block int, value binary").collect():  # of fixed size: buckets x dim
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["value"], kind).reshape(BLOCK, -1)
    return out[: shape[0]]


def fitted_weights(rows: DataFrame, totals: np.ndarray, p: ToxicityParams) -> dict[str, np.ndarray]:
    """Weights trained on all of rows: _id, text, toxic. totals: rows of class 0 and of class 1."""
    context, schema = rows.sparkSession.sparkContext, "block int, at binary, change binary"
    shards = max(1, -(-int(totals.sum()) // p.shard))
    key = F.xxhash64("_id", F.lit(p.seed))
    rows = rows.repartitionById(shards, F.pmod(key, F.lit(shards)).cast("int")).sortWithinPartitions(F.xxhash64("_id"), "_id").select("text", "toxic")
    rows = rows.persist(StorageLevel.DISK_ONLY)  # a partition is a shard, in the same order in every epoch

    def pairs(batches):
        for pdf in batches:
            yield pdf["text"].fillna("").tolist(), pdf["toxic"].to_numpy(np.int64)

    def count(batches):
        present: np.ndarray | int = 0
        for texts, y in pairs(batches):
            present = present + _presence(texts, y, p)
        if not isinstance(present, int):
            at = np.flatnonzero(present.any(axis=1))
            yield from _changes(at, present[at])

    try:
        present = _added(rows.mapInPandas(lean(count), schema), (p.buckets * (1 + len(p.prefixes)), 2), mean=False)
        weights = _first_weights(present, totals, p, np.random.default_rng(p.seed))
        del present
        for epoch in range(p.epochs):
            shared = context.broadcast(weights)  # of fixed size: buckets x dim

            def run(batches, shared=shared, epoch=epoch):
                before = shared.value
                own = {k: v.copy() for k, v in before.items()}
                used = train(pairs(batches), own, totals, p, epoch)
                if used.any():
                    change = _flat(own)
                    change -= _flat(before)
                    at = np.flatnonzero(np.append(used, np.ones(len(change) - len(used), bool)))
                    yield from _changes(at, change[at])

            table = _flat(weights)
            table += _added(rows.mapInPandas(lean(run), schema), table.shape, mean=True)
            weights = _unflat(table, weights)
            np.maximum(weights["v"], 0, out=weights["v"])
            shared.destroy()
        return weights
    finally:
        rows.unpersist()


def _platt(rows: DataFrame) -> tuple[float, float]:
    """Scale and shift of logits by logistic regression over all of rows: raw, toxic (Newton steps)."""

    def sums(t: np.ndarray):
        x, y = F.least(F.greatest(F.col("raw"), F.lit(-30.0)), F.lit(30.0)), F.col("toxic")
        z = F.lit(float(t[0])) * x + F.lit(float(t[1]))
        q = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
        s, v = z * (1 - 2 * y), q * (1 - q)
        loss, ga, gb, aa, ab, bb = rows.agg(*[F.sum(c) for c in (F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))), (q - y) * x, q - y, v * x * x, v * x, v)]).first()
        return loss + 0.5 * np.sum((t - [1.0, 0.0]) ** 2), np.array([ga, gb]) + (t - [1.0, 0.0]), np.array([[aa, ab], [ab, bb]]) + np.eye(2)

    t = np.array([1.0, 0.0])
    now = sums(t)
    for _ in range(25):
        step, size = np.linalg.solve(now[2], now[1]), 1.0
        while (then := sums(t - size * step))[0] > now[0] and size > 1e-3:
            size /= 2
        t, now = t - size * step, then
        if np.abs(size * step).max() < 1e-7:
            break
    return round(float(t[0]), 9), round(float(t[1]), 9)  # sums of floats hang on their order


def best_threshold(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Threshold of the highest weighted F1, in the middle of the gap below the lowest score it accepts."""
    order = np.argsort(-score, kind="stable")
    s, hit, wt = score[order], (y * w)[order], w[order]
    f1 = 2 * np.cumsum(hit) / np.maximum(np.cumsum(wt) + hit.sum(), 1e-9)
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def fitted_thresholds(rows: DataFrame, p: ToxicityParams) -> dict[str, float]:
    """best_threshold over all of rows (lang, toxic, score), and over those of each language; "*" is all languages."""
    own = rows.where("lang <> ''").select("lang", "score", "toxic")
    rows = own.unionByName(rows.select(F.lit(None).cast("string").alias("lang"), "score", "toxic")).groupBy("lang", "score").agg(F.sum("toxic").alias("hit"), F.count("*").alias("n"))
    down, whole = Window.partitionBy("lang").orderBy(F.desc("score")), Window.partitionBy("lang")
    f1 = 2 * F.sum("hit").over(down) / (F.sum("n").over(down) + F.sum("hit").over(whole))
    cuts = rows.select("lang", "hit", F.struct(f1.alias("f1"), "score", ((F.col("score") + F.lead("score", 1, 0.0).over(down)) / 2).alias("cut")).alias("best"))
    best = cuts.groupBy("lang").agg(F.max("best").alias("best"), F.sum("hit").alias("hits")).where(F.col("lang").isNull() | (F.col("hits") >= p.min_positives))
    return {r["lang"] or "*": r["best"]["cut"] for r in best.collect()}


def fit(rows: DataFrame, p: ToxicityParams) -> ToxicityModel:
    """rows: _id, text, lang, toxic, held, one a labelled document. Those held are for calibration."""
    n = np.zeros((2, 2), np.int64)
    for r in rows.groupBy("held", "toxic").count().collect():
        n[int(r["held"]), r["toxic"]] = r["count"]
    if not n.sum(0).all():
        return ToxicityModel(p, None)
    if n.all():
        use, check, totals = rows.where("NOT held"), rows.where("held"), n[0]
    else:
        use, check, totals = rows, rows, n.sum(0)
    weights = fitted_weights(use, totals, p)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def judge(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "toxic": pdf["toxic"], "raw": logits(pdf["text"].tolist(), shared.value, p)})

    found = check.select("text", "lang", "toxic").mapInPandas(lean(judge), "lang string, toxic int, raw double")
    found = materialize(found.where(F.col("raw") > F.lit(float("-inf"))), "calibration")
    if found.isEmpty():
        return ToxicityModel(p, None)
    a, b = _platt(found)
    z = F.least(F.greatest(F.lit(a) * F.col("raw") + F.lit(b), F.lit(-30.0)), F.lit(30.0))
    return ToxicityModel(p, weights, (a, b), fitted_thresholds(found.withColumn("score", 1 / (1 + F.exp(-z))), p))


def labelled(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> DataFrame:
    """Every labelled document: _id, text, lang, toxic, held."""
    named = _classes(labels)
    ids = named.select("_id")
    bits = 1 << max(16, (16 * ids.count()).bit_length())
    place = F.pmod(F.xxhash64("_id"), F.lit(bits))
    marks = np.zeros(bits // 8, np.uint8)  # so texts without a label needn't be shuffled
    for r in ids.select((place + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect():
        marks[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        return pd.Series((shared.value[h.to_numpy() >> 3] >> (h.to_numpy() & 7) & 1).astype(bool))

    text = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text", "lang").where("_id IS NOT NULL")
    found = text.where(marked(place)).join(named, "_id").groupBy("_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic"))
    return found.withColumn("held", F.pmod(F.xxhash64("_id", F.lit("held")), F.lit(10_000)) < F.lit(round(p.held_out * 10_000)))


def _classes(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IN (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> pd.DataFrame:
    """At most max_labelled documents of each class, by hash order, to look at on the driver; models are not fitted to it.
    The weight of a row makes up for the sampling."""
    named = _classes(labels)
    totals = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for cls in sorted(totals):
        part = named.where(F.col("toxic") == cls).orderBy(F.xxhash64("_id"), "_id").limit(p.max_labelled)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return pd.DataFrame({"text": [], "lang": [], "toxic": [], "weight": []})
    chosen = picked.toPandas()  # at most twice max_labelled pairs of integers
    chosen = docs.sparkSession.createDataFrame(chosen, "_id bigint, toxic int")
    text = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text", "lang")
    found = text.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic"))
    found = materialize(found, "labelled")
    sizes = found.select("_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("_id"), "_id").toPandas()
    held = sizes[sizes["n"].cumsum() <= p.max_chars]
    if len(held) < len(sizes):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(held[["_id"]], "_id bigint")), "_id", "left_semi")
    rows = found.toPandas().sort_values("_id", ignore_index=True)
    fitted = rows["toxic"].value_counts()
    rows["weight"] = [max(1.0, totals[t] / max(p.max_labelled, fitted[t]) if len(held) == len(sizes) else totals[t] / fitted[t]) for t in rows["toxic"]]
    return rows


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, lang, toxicity and flagged for every row of docs."""
    if model.weights is None:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.lit(0.0).alias("toxicity"), F.lit(False).alias("flagged"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x dim

    def run(batches):
        m = shared.value
        for pdf in batches:
            raw = logits(pdf["text"].tolist(), m.weights, m.params)
            s = np.where(np.isfinite(raw), 1 / (1 + np.exp(-np.clip(m.scale[0] * raw + m.scale[1], -30, 30))), 0.0)
            limit = pdf["lang"].map(lambda x: m.threshold(x if isinstance(x, str) else None)).to_numpy(float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "toxicity": s, "flagged": s > limit})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").mapInPandas(lean(run), "doc_id bigint, lang string, toxicity double, flagged boolean")


def model_for(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    model = fit(materialize(labelled(docs, labels, p), "labelled"), p)
    trim()
    return model


def flag(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The documents that the classifier takes for toxic: doc_id, lang, toxicity."""
    return score(docs, model_for(docs, labels, p)).where("flagged").drop("flagged")


def reject(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """docs without the rows that are flagged, with or without a doc_id; all columns stay."""
    model = model_for(docs, labels, p)
    if model.weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        for text, lang in batches:
            raw = logits(text.tolist(), m.weights, m.params)
            s = np.where(np.isfinite(raw), 1 / (1 + np.exp(-np.clip(m.scale[0] * raw + m.scale[1], -30, 30))), 0.0)
            yield pd.Series(s <= lang.map(lambda x: m.threshold(x if isinstance(x, str) else None)).to_numpy(float))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return lean(judge)(batches)

    return docs.where(clean(F.col("text"), F.col("lang")))
