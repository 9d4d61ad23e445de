"""Substring dedup: long passages that repeat across documents, by de Bruijn compaction.

1. Edges. Token k-mers are the edges of a (sparse) de Bruijn graph: of every `sample`
   consecutive k-mers the one of the smallest hash is taken, so any two copies of a
   passage of k + sample - 1 = `least_words` words take at least one k-mer in common,
   and nothing shorter is asked for. Every run of `least_words` words belongs to the
   edge that is the smallest in it. Edges seen in one document only are dropped.
2. Links. Edges that follow each other in a document are linked. Where an edge has one
   successor, which has one predecessor, the path does not branch; such paths are
   compacted by pointer jumping, one Spark join a round, so a path of m edges takes
   log2(m) rounds. The edges of a path that runs in a circle stay single.
3. Paths. Where a document runs along a path, the words from the first edge to the last
   are one unit, named by the path, the steps and the hashes of the words between the
   edges. A unit that another document holds too is confirmed as one, however long it is
   and however many documents hold it.
4. Coordinates. What is left is compared word by word at its source: the runs that reach
   beyond a unit, and those of units that stand in one document only. They are hashed and
   kept if another document holds the same run; of units that were confirmed one document
   speaks for all. A task settles what repeats among its own documents and sends one
   witness of it, so a run that a third of all documents hold doesn't pile up anywhere.
   Kept runs and units that touch merge into spans.

So a word is in a span exactly if it lies in a run of `least_words` words that at least
two documents hold (runs are compared by 64-bit hashes).

Defined results: null, empty and short texts have no spans; a passage that repeats in
one document only is not reported, nor are repeated rows of one doc_id against each
other; rows with the same doc_id and different texts have their spans each; a null
doc_id can't be named and is left out; a very long text is read whole; an empty table
gives an empty result; other columns are not touched, whatever their names. start and
end count words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import squeeze, unsqueeze
from .store import materialize
from .text import RunHash, Words, chunks, gram_hashes, lean, signed


@dataclass(frozen=True)
class SubstringParams:
    least_words: int = 50
    k: int = 16
    segment_runs: int = 500_000

    @property
    def sample(self) -> int:
        return self.least_words - self.k + 1


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every run of w values, by doubling."""
    m, size = x, 1
    while size * 2 <= w:
        m = best(m[:-size], m[size:])
        size *= 2
    return m if size == w else best(m[: len(m) - (w - size)], m[w - size :])


def sampled_edges(hashes: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the k-mers that are the smallest of some run of `sample` k-mers."""
    grams = gram_hashes(hashes, p.k)
    if len(grams) < p.sample:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = sliding(grams, p.sample, np.minimum)
    pad = np.zeros(p.sample - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), p.sample, np.maximum) == grams)
    return at, grams[at]


def owners(hashes: np.ndarray, at: np.ndarray, edge: np.ndarray, p: SubstringParams) -> np.ndarray:
    """For every run of least_words words, the place among `at` of the edge that it belongs to: the first of the smallest in it."""
    low = sliding(gram_hashes(hashes, p.k), p.sample, np.minimum)
    own = np.searchsorted(at, np.arange(len(low)))
    wrong = np.flatnonzero(edge[own] != low)
    while len(wrong):
        own[wrong] += 1
        wrong = wrong[edge[own[wrong]] != low[wrong]]
    return own


def _word_lists(texts: list[str | None]):
    for a, b in chunks([len(t or "") for t in texts]):
        w = Words(texts[a:b])
        for i in range(b - a):
            yield a + i, w.hashes[w.bounds[i] : w.bounds[i + 1]]


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("version", F.xxhash64("text"))


EDGE = "at array<int>, edge array<long>, first array<int>, last array<int>, between array<long>"


def edges(docs: DataFrame, p: SubstringParams) -> DataFrame:
    """doc_id, version and arrays over the edges of the document: their places and hashes, the first and last run that belongs to each, and the hash of the words up to the next edge."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, hashes in _word_lists(pdf["text"].tolist()):
                at, own = sampled_edges(hashes, p)
                if not len(at):
                    continue
                used, first = np.unique(owners(hashes, at, own, p), return_index=True)
                last = np.append(first[1:], len(hashes) - p.least_words + 1) - 1
                at, own = at[used], own[used]
                between = np.append(RunHash(hashes).of(at[:-1], at[1:]), np.uint64(0))
                rows.append((pdf["doc_id"].iat[i], pdf["version"].iat[i], at.astype(np.int32), signed(own), first.astype(np.int32), last.astype(np.int32), signed(between)))
            yield pd.DataFrame(rows, columns=["doc_id", "version", "at", "edge", "first", "last", "between"])

    return _picked(docs).mapInPandas(lean(run), f"doc_id long, version long, {EDGE}")


def links(occurrences: DataFrame, parts: int) -> DataFrame:
    """Distinct (a, b) of repeated edges that follow each other in a document."""

    def run(batches):
        held = [tuple(pdf[c].to_numpy() for c in ("doc_id", "version", "number", "edge")) for pdf in batches]
        if not held:
            return
        doc, version, number, edge = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((number, version, doc))
        doc, version, number, edge = doc[order], version[order], number[order], edge[order]
        next_ = (doc[1:] == doc[:-1]) & (version[1:] == version[:-1]) & (number[1:] == number[:-1] + 1)
        yield pd.DataFrame({"a": edge[:-1][next_], "b": edge[1:][next_]}).drop_duplicates()

    return occurrences.select("doc_id", "version", "number", "edge").repartition(parts, "doc_id").mapInPandas(lean(run), "a long, b long").distinct()


def compact(edges_: DataFrame, links_: DataFrame) -> DataFrame:
    """edge, path, step: for every one of edges_, the first edge of its path and the steps from it; an edge alone is a path of its own."""
    one = links_.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    only = links_.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").select("b", "a")
    follows = materialize(one.join(only, ["a", "b"]).where("a <> b"), "follows")
    inner = follows.select(F.col("b").alias("edge"))
    step = lambda n: F.lit(n).cast("bigint").alias("step")
    heads = edges_.select("edge").join(inner, "edge", "left_anti").select("edge", F.col("edge").alias("path"), step(0), F.lit(True).alias("done"))
    table = materialize(follows.select(F.col("b").alias("edge"), F.col("a").alias("path"), step(1), F.lit(False).alias("done")).unionByName(heads), "paths")
    rounds = max(1, table.count()).bit_length() + 1
    for _ in range(rounds):
        if table.where("NOT done").isEmpty():
            break
        further = table.select(F.col("edge").alias("path"), F.col("path").alias("to"), F.col("step").alias("more"), F.col("done").alias("ended"))
        moved = table.where("NOT done").join(further, "path").select("edge", F.col("to").alias("path"), (F.col("step") + F.col("more")).alias("step"), F.col("ended").alias("done"))
        table = materialize(table.where("done").unionByName(moved), "paths")
    circle = ~F.col("done")
    return table.select("edge", F.when(circle, F.col("edge")).otherwise(F.col("path")).alias("path"), F.when(circle, 0).otherwise(F.col("step")).alias("step"))


def along_paths(es: dict[str, np.ndarray], p: SubstringParams) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int | None]]]:
    """Of one document's shared edges, in order: units (name, first run, last run), and pieces (edge, first run, last run, name of the unit or None)."""
    number, path, step = es["number"], es["path"], es["step"]
    new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1] + 1) | (path[1:] != path[:-1]) | (step[1:] != step[:-1] + 1)]))
    units, pieces = [], []
    for i, j in zip(new.tolist(), np.append(new[1:], len(number)).tolist(), strict=True):
        a, b = int(es["at"][i]), int(es["at"][j - 1]) + p.k - p.least_words
        name = None
        if a <= b:
            words = np.concatenate([[path[i], step[i], j - i], es["between"][i : j - 1]]).astype(np.int64)
            name = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)
            units.append((name, a, b))
        for t in range(i, j):
            edge, first, last = int(es["edge"][t]), int(es["first"][t]), int(es["last"][t])
            if name is None:
                pieces.append((edge, first, last, None))
                continue
            for low, high, own in ((first, min(last, a - 1), None), (max(first, a), min(last, b), name), (max(first, b + 1), last, None)):
                if low <= high:
                    pieces.append((edge, low, high, own))
    return units, pieces


#: kind: 0 for runs that ask whether others hold them, 1 for confirmed runs, 2 for the documents (low) and versions (high) of a segment.
RUNS = "bucket int, segment long, kind int, hashes binary, low binary, high binary, text binary, at binary"


def settle(segment: int, parts: int, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray, at: np.ndarray) -> list[tuple]:
    """Rows of the runs of a segment. A run stands in documents low to high; where they differ, it speaks for others and is not returned.
    What repeats within the segment is confirmed at once and sends one witness; the rest asks."""
    order = np.argsort(hashes, kind="stable")
    hashes, low, high, text, at = (x[order] for x in (hashes, low, high, text, at))
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    least, most = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    repeats = np.repeat(least != most, np.diff(np.append(first, len(hashes))))
    own, rows = repeats & (low == high), []
    if own.any():
        rows.append((segment % parts, segment, 1, b"", b"", b"", squeeze(text[own]), squeeze(at[own])))
    every = np.concatenate([np.flatnonzero(~repeats), first[least != most]])
    low, high = (np.concatenate([x[~repeats], y[least != most]]) for x, y in ((low, least), (high, most)))
    bucket = (hashes[every] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(parts + 1, dtype=np.uint64))
    for k in range(parts):
        if len(i := order[cut[k] : cut[k + 1]]):
            rows.append((k, segment, 0, hashes[every[i]].tobytes(), squeeze(low[i]), squeeze(high[i] - low[i]), squeeze(text[every[i]]), squeeze(at[every[i]])))
    return rows


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the unions of what meets or touches in a document. doc: small numbers."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = doc.astype(np.int64) << 40
    reach = np.maximum.accumulate(end + base)
    first = np.flatnonzero(np.concatenate([[True], (start + base)[1:] > reach[:-1]]))
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _confirmed(asked: DataFrame, p: SubstringParams, parts: int) -> DataFrame:
    """doc_id, version, start, end of the runs that several documents hold. asked: doc_id, version, text, and the ranges of runs (first, last, low, high)."""

    def hashed(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        names: list[tuple[int, int]] = []
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pd.DataFrame:
            segment = base + number
            ids, versions = (np.array(x, np.int64) for x in zip(*names, strict=True))
            rows = [(segment % parts, segment, 2, b"", squeeze(ids), squeeze(versions), b"", b""), *settle(segment, parts, *(np.concatenate(x) for x in zip(*held, strict=True)))]
            return pd.DataFrame(rows, columns=["bucket", "segment", "kind", "hashes", "low", "high", "text", "at"])

        for pdf in batches:
            for i, hashes in _word_lists(pdf["text"].tolist()):
                first, last, low, high = (np.asarray(pdf[c].iat[i], np.int64) for c in ("first", "last", "low", "high"))
                n = last - first + 1
                starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                held.append((RunHash(hashes).of(starts, starts + p.least_words), np.repeat(low, n), np.repeat(high, n), np.full(len(starts), len(names), np.int32), starts.astype(np.int32)))
                names.append((pdf["doc_id"].iat[i], pdf["version"].iat[i]))
                size += len(starts)
                if size > p.segment_runs:
                    yield flush()
                    number, names, held, size = number + 1, [], [], 0
        if held:
            yield flush()

    def confirm(batches):
        rows = []
        for pdf in batches:
            settled = pdf["kind"] > 0
            if settled.any():
                yield pdf.loc[settled, ["segment", "kind", "low", "high", "text", "at"]]
            rows += list(pdf[~settled].itertuples(index=False))
        if not rows:
            return
        hashes = [np.frombuffer(r.hashes, np.uint64) for r in rows]
        every = np.concatenate(hashes)
        low = np.concatenate([unsqueeze(r.low, np.int64) for r in rows])
        high = low + np.concatenate([unsqueeze(r.high, np.int64) for r in rows])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        keep = np.zeros(len(every), bool)
        keep[order] = np.repeat(np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first), np.diff(np.append(first, len(every))))
        keep &= low == high
        begin = 0
        for r, h in zip(rows, hashes, strict=True):
            own = keep[begin : begin + len(h)]
            begin += len(h)
            if own.any():
                yield pd.DataFrame({"segment": [r.segment], "kind": [1], "low": [b""], "high": [b""], "text": [squeeze(unsqueeze(r.text, np.int32)[own])], "at": [squeeze(unsqueeze(r.at, np.int32)[own])]})

    def spans_of(names: tuple[bytes, bytes], parts_: list[tuple[bytes, bytes]]) -> pd.DataFrame:
        text, at = (np.concatenate([unsqueeze(x[k], np.int32) for x in parts_]) for k in (0, 1))
        text, start, end = merge_spans(text, at, at + p.least_words)
        return pd.DataFrame({"doc_id": unsqueeze(names[0], np.int64)[text], "version": unsqueeze(names[1], np.int64)[text], "start": start, "end": end})

    def spans(batches):
        segment, names, held = None, None, []
        for pdf in batches:
            for s, kind, low, high, text, at in pdf[["segment", "kind", "low", "high", "text", "at"]].itertuples(index=False):
                if s != segment:
                    if held:
                        yield spans_of(names, held)
                    segment, names, held = s, None, []
                if kind == 2:
                    names = low, high
                else:
                    held.append((text, at))
        if held:
            yield spans_of(names, held)

    runs = asked.select("doc_id", "version", "text", "first", "last", "low", "high").mapInPandas(lean(hashed), RUNS)
    kept = runs.repartitionById(parts, "bucket").mapInPandas(lean(confirm), "segment long, kind int, low binary, high binary, text binary, at binary")
    return kept.repartition(parts, "segment").sortWithinPartitions("segment").mapInPandas(lean(spans), "doc_id long, version long, start long, end long")


def repeated_spans(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, start, end, n_words of every passage that another document holds too."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(edges(docs, p), "edges")
    spread = found.select("doc_id", "version", F.posexplode(F.arrays_zip("at", "edge", "first", "last", "between")).alias("number", "e")).select("doc_id", "version", "number", "e.*")
    shared = spread.groupBy("edge").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("edge")
    occurrences = materialize(spread.join(shared, "edge"), "occurrences")
    paths = compact(occurrences.select("edge").distinct(), materialize(links(occurrences, parts), "links"))
    fields = ("number", "at", "edge", "first", "last", "between", "path", "step")
    placed = occurrences.join(paths, "edge").groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct(*fields))).alias("es"))

    def follow(batches):
        for pdf in batches:
            made = [along_paths({f: np.asarray(x) for f, x in zip(fields, columns, strict=True)}, p) for columns in zip(*(pdf[f] for f in fields), strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "version": pdf["version"], "units": [u for u, _ in made], "pieces": [x for _, x in made]})

    shape = "doc_id long, version long, units array<struct<unit:long,first:int,last:int>>, pieces array<struct<edge:long,first:int,last:int,unit:long>>"
    along = materialize(placed.select("doc_id", "version", *[F.col(f"es.{f}").alias(f) for f in fields]).mapInPandas(lean(follow), shape), "along")
    units, pieces = (along.select("doc_id", "version", F.inline(c)) for c in ("units", "pieces"))
    whole = materialize(units.groupBy("unit").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high"), "whole")
    inside = pieces.where("unit IS NOT NULL")
    alone = pieces.where("unit IS NULL").unionByName(inside.join(whole, "unit", "left_anti").select(pieces.columns))
    alone = materialize(alone.select("doc_id", "version", "edge", "first", "last"), "pieces")
    # of a confirmed unit one document speaks for all, at the edges that others still ask about
    who = F.min(F.struct("doc_id", "version", "first", "last")).alias("w")
    speakers = inside.join(alone.select("edge").distinct(), "edge", "left_semi").groupBy("edge", "unit").agg(who).join(whole, "unit")
    asking = alone.select("doc_id", "version", "first", "last", F.col("doc_id").alias("low"), F.col("doc_id").alias("high")).unionByName(speakers.select("w.*", "low", "high"))
    ranges = ("first", "last", "low", "high")
    asked = asking.groupBy("doc_id", "version").agg(F.collect_list(F.struct(*ranges)).alias("rs")).select("doc_id", "version", *[F.col(f"rs.{f}").alias(f) for f in ranges])
    runs = _confirmed(_picked(docs).join(asked, ["doc_id", "version"]), p, parts)
    across = units.join(whole.select("unit"), "unit").select("doc_id", "version", F.col("first").cast("long").alias("start"), (F.col("last") + p.least_words).cast("long").alias("end"))

    def merge(batches):
        for pdf in batches:
            doc = np.repeat(np.arange(len(pdf)), pdf["start"].map(len))
            if len(doc):
                doc, start, end = merge_spans(doc, *(np.concatenate(pdf[c].tolist()) for c in ("start", "end")))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[doc], "start": start, "end": end, "n_words": end - start})

    spans = runs.unionByName(across).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end")).mapInPandas(lean(merge), "doc_id long, start long, end long, n_words long").distinct()


def oracle(least_words: int = 50) -> str:
    """The same spans as DuckDB SQL over the view documents: every run of words, written out."""
    n = least_words
    return rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
r AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {n}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS i FROM t)),
k AS (SELECT h FROM r GROUP BY h HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT DISTINCT doc_id, i FROM r WHERE h IN (SELECT h FROM k)),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {n} THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s)
SELECT doc_id, min(i) AS start, max(i) + {n} AS "end", max(i) + {n} - min(i) AS n_words FROM g GROUP BY doc_id, span"""
