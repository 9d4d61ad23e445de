"""Benchmark decontamination with a positional inverted index.

The index is cut by document into segments. A segment holds, for every term of its
documents, the sorted positions of all occurrences (delta coded, compressed);
nothing of the corpus is shuffled to build it, and it is written once to the shared
folder. A search reads the collection frequency of the benchmark's terms from the
dictionaries, then works in each segment alone: the positions of the rarest term of
a window of words, less its offset, are intersected with those of the next rarest
term, and so on. What is left are exact phrases. Proximity matches let each term be
`slack` words off its place and ask that the terms found carry `near_share` of the
window's inverse-frequency weight; they are sought from as many of the rarest words
as weigh more than may be missing, so none is lost. A near window that starts less than window + slack
words from an exact phrase of its item in the same document is not reported again.

Benchmark arrays are broadcast in passes of at most `pass_words` words each, so the
size of a broadcast does not depend on the benchmark's.

Defined results: an item of fewer than `least_words` words is not searched; one
shorter than a window is searched whole; null or empty texts match nothing;
repeated rows of documents are found once each, repeated items too; a null doc_id
can't be reported and is left out (`reject` keeps the row); other columns are not
touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free_name, materialize
from .text import Words, chunks, lean, signed

INDEX = "segment long, docs binary, bounds binary, terms binary, counts binary, positions binary"
MATCH = "doc_id long, item_id long, kind string, item_from int, item_to int, doc_from long, doc_to long"


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 13
    least_words: int = 8
    slack: int = 3
    near_share: float = 0.8
    segment_words: int = 1_000_000
    pass_words: int = 2_000_000


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unsqueeze(raw: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).ravel()


@dataclass
class Segment:
    """terms: sorted hashes; starts: where each term's positions begin; positions: of the words of all documents in a row."""

    doc_ids: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray

    @staticmethod
    def build(doc_ids: list[int], hashes: list[np.ndarray]) -> Segment:
        words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(words, kind="stable")
        ordered = words[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
        return Segment(np.array(doc_ids, np.int64), bounds, ordered[first], np.append(first, len(words)), order.astype(np.uint32))

    def dump(self) -> tuple[bytes, ...]:
        gaps = np.diff(self.positions, prepend=np.uint32(0))
        gaps[self.starts[:-1]] = self.positions[self.starts[:-1]]
        term_gaps = np.diff(self.terms, prepend=np.uint64(0))
        return squeeze(self.doc_ids), squeeze(self.bounds), squeeze(term_gaps), squeeze(np.diff(self.starts).astype(np.uint32)), squeeze(gaps)

    @staticmethod
    def load(docs: bytes, bounds: bytes, terms: bytes, counts: bytes, positions: bytes) -> Segment:
        starts = np.concatenate([[0], np.cumsum(unsqueeze(counts, np.uint32).astype(np.int64))])
        gaps = unsqueeze(positions, np.uint32).astype(np.int64)
        run = np.cumsum(gaps)
        before = np.concatenate([[0], run])[starts[:-1]]
        return Segment(unsqueeze(docs, np.int64), unsqueeze(bounds, np.int64), np.cumsum(unsqueeze(terms, np.uint64), dtype=np.uint64), starts, (run - np.repeat(before, np.diff(starts))).astype(np.uint32))


@dataclass
class Tests:
    """Benchmark windows. words: word hashes of all items in a row; start, width, item: of each window;
    ranked: offsets in each window from the rarest word on; weight: of each word; full: weight of each window, summed in the order of ranked."""

    items: np.ndarray
    offsets: np.ndarray
    words: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    width: np.ndarray
    item: np.ndarray
    ranked: np.ndarray
    full: np.ndarray


def make_tests(items: list[tuple[int, np.ndarray]], frequency: dict[int, int], p: DecontaminationParams) -> Tests:
    items = [(i, w) for i, w in items if len(w) >= p.least_words]
    words = np.concatenate([w for _, w in items]) if items else np.empty(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(w) for _, w in items])]).astype(np.int64)
    count = np.array([frequency.get(int(w), 0) for w in words], np.int64)
    total = max(sum(frequency.values()), 1)
    weight = np.log1p(total / np.maximum(count, 1))
    start, width, item = [], [], []
    for k, (_, w) in enumerate(items):
        n = min(p.window, len(w))
        for s in range(len(w) - n + 1):
            start.append(offsets[k] + s)
            width.append(n)
            item.append(k)
    start, width, item = (np.array(x, np.int64) for x in (start, width, item))
    ranked = np.full((len(start), p.window), -1, np.int64)
    for k, (s, n) in enumerate(zip(start, width, strict=True)):
        ranked[k, :n] = np.argsort(count[s : s + n], kind="stable")
    full = np.zeros(len(start))
    for rank in range(p.window):
        full += np.where(ranked[:, rank] >= 0, weight[start + np.maximum(ranked[:, rank], 0)], 0) if len(start) else 0
    return Tests(np.array([i for i, _ in items], np.int64), offsets, words, weight, start, width, item, ranked, full)


def search(g: Segment, t: Tests, p: DecontaminationParams) -> list[tuple]:
    """Matches in one segment: (doc_id, item_id, kind, item_from, item_to, doc_from, doc_to)."""
    if not len(t.start) or not len(g.positions):
        return []
    place = np.minimum(np.searchsorted(g.terms, t.words), len(g.terms) - 1)
    known = g.terms[place] == t.words
    keys = (np.repeat(np.arange(len(g.terms), dtype=np.uint64), np.diff(g.starts)) << np.uint64(32)) | g.positions.astype(np.uint64)
    key = lambda word, at: (place[word].astype(np.uint64) << np.uint64(32)) | np.clip(at, 0, 2**32 - 1).astype(np.uint64)

    document = lambda at: np.searchsorted(g.bounds, at, "right") - 1

    def occurrences(windows: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, the positions at which they would start by their word of this rank, and the documents that hold the word."""
        offset = t.ranked[windows, rank]
        word = t.start[windows] + offset
        n = np.where(known[word], g.starts[place[word] + 1] - g.starts[place[word]], 0)
        from_ = np.repeat(g.starts[place[word]], n)
        at = g.positions[from_ + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
        return np.repeat(windows, n), at - np.repeat(offset, n), document(at)

    def whole(windows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """True where the window at this position lies in one document."""
        ok = (at >= 0) & (at + t.width[windows] <= g.bounds[-1])
        doc = document(np.where(ok, at, 0))
        return ok & (at + t.width[windows] <= g.bounds[np.minimum(doc + 1, len(g.bounds) - 1)])

    everything = np.arange(len(t.start))
    windows, at, _ = occurrences(everything, 0)
    ok = whole(windows, at)
    windows, at = windows[ok], at[ok]
    for rank in range(1, p.window):
        offset = t.ranked[windows, rank]
        word = t.start[windows] + np.maximum(offset, 0)
        k = key(word, at + offset)
        ok = (offset < 0) | (known[word] & (keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k))
        windows, at = windows[ok], at[ok]
    out = _spans(g, t, windows, at, document(at), "phrase")
    phrases = np.sort((t.item[windows] << 40) + at)

    tried, before = [], np.zeros(len(t.start))
    for rank in range(p.window):
        # the rarest words that weigh more than may be missing: a match has one of them
        tried.append(occurrences(everything[(t.ranked[:, rank] >= 0) & (before <= (1 - p.near_share) * t.full)], rank))
        before += np.where(t.ranked[:, rank] >= 0, t.weight[t.start + np.maximum(t.ranked[:, rank], 0)], 0)
    # a window may begin before its document or end after it; what lies outside is missing
    windows, at, doc = (np.concatenate(x) for x in zip(*tried, strict=True))

    def near(windows: np.ndarray, at: np.ndarray, doc: np.ndarray, slack: int) -> np.ndarray:
        """The places in these arrays where enough of the window's words are at most `slack` words off."""
        low, high = g.bounds[doc], g.bounds[doc + 1]
        missing, alive = np.zeros(len(windows)), np.arange(len(windows))
        for rank in range(p.window):
            w, a = windows[alive], at[alive]
            offset = t.ranked[w, rank]
            word = t.start[w] + np.maximum(offset, 0)
            first = np.maximum(a + offset - slack, low[alive])
            last = np.minimum(a + offset + slack, high[alive] - 1)
            i = np.searchsorted(keys, key(word, first))
            hit = (offset < 0) | (known[word] & (last >= first) & (keys[np.minimum(i, len(keys) - 1)] <= key(word, last)) & (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] >= key(word, first)))
            missing[alive] += np.where(hit, 0, t.weight[word])
            alive = alive[missing[alive] <= (1 - p.near_share) * t.full[w]]
        return alive

    # the word that was found may itself be off its place: where the window doesn't match there, the places around are tried
    wide = near(windows, at, doc, 2 * p.slack)
    windows, at, doc = windows[wide], at[wide], doc[wide]
    found, left = [], np.arange(len(windows))
    for shift in sorted(range(-p.slack, p.slack + 1), key=abs):
        hit = near(windows[left], at[left] + shift, doc[left], p.slack)
        found.append((windows[left[hit]], at[left[hit]] + shift, doc[left[hit]]))
        left = np.delete(left, hit)
    windows, at, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    # windows that lie on a phrase of their item are reported already, if it is the same document's
    place_of = (t.item[windows] << 40) + at
    i = np.searchsorted(phrases, place_of)
    free = np.ones(len(windows), bool)
    if len(phrases):
        for next_to in (phrases[np.minimum(i, len(phrases) - 1)], phrases[np.maximum(i - 1, 0)]):
            same = document(next_to & ((1 << 40) - 1)) == doc
            free &= ~same | (np.abs(next_to - place_of) >= p.window + p.slack)
    return out + _spans(g, t, windows[free], at[free], doc[free], "near")


def _spans(g: Segment, t: Tests, windows: np.ndarray, at: np.ndarray, doc: np.ndarray, kind: str) -> list[tuple]:
    """Merges windows of one item that touch in a document: on the same line for phrases, wherever they meet for near matches."""
    if not len(windows):
        return []
    item, inside = t.item[windows], t.start[windows] - t.offsets[t.item[windows]]
    width = t.width[windows]
    begin, end = np.maximum(at - g.bounds[doc], 0), np.minimum(at + width, g.bounds[doc + 1]) - g.bounds[doc]
    line = at - inside if kind == "phrase" else np.zeros(len(at), np.int64)
    order = np.lexsort((begin, line, item, doc))
    item, inside, width, doc, begin, end, line = (x[order] for x in (item, inside, width, doc, begin, end, line))
    same = (item[1:] == item[:-1]) & (doc[1:] == doc[:-1]) & (line[1:] == line[:-1])
    reach = np.maximum.accumulate(end + doc * (1 << 32))[:-1] - doc[1:] * (1 << 32)
    new = np.concatenate([[True], ~same | (begin[1:] > reach)])
    k = np.flatnonzero(new)
    low, high = np.minimum.reduceat(inside, k), np.maximum.reduceat(inside + width, k)
    stop = np.maximum.reduceat(end, k)
    return [(int(g.doc_ids[doc[i]]), int(t.items[item[i]]), kind, int(a), int(b), int(begin[i]), int(c)) for i, a, b, c in zip(k, low, high, stop, strict=True)]


def build_index(docs: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The positional index of all documents, written to the shared folder: one row a segment."""

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        ids, held, size = [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame([(base + number, *Segment.build(ids, held).dump())], columns=["segment", "docs", "bounds", "terms", "counts", "positions"])

        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks([len(t or "") for t in texts]):
                w = Words(texts[a:b])
                for i in range(a, b):
                    own = w.hashes[w.bounds[i - a] : w.bounds[i - a + 1]]
                    if size and size + len(own) > p.segment_words:
                        yield flush()
                        number, ids, held, size = number + 1, [], [], 0
                    ids.append(int(pdf["doc_id"].iat[i]))
                    held.append(own)
                    size += len(own)
        if ids:
            yield flush()

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return materialize(picked.mapInPandas(lean(run), INDEX), "postings")


def find_matches(index: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """Exact phrases and near matches of the benchmark's items in the indexed documents."""
    spark = index.sparkSession
    named = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    passes = max(1, -(-(named.agg(F.sum(F.length("text"))).first()[0] or 0) // (6 * p.pass_words)))
    out = None
    for k in range(passes):
        rows = named.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("item_id", "text").collect()  # about pass_words words
        w = Words([r["text"] for r in rows])
        items = [(r["item_id"], w.hashes[w.bounds[i] : w.bounds[i + 1]]) for i, r in enumerate(rows)]
        vocabulary = spark.sparkContext.broadcast(np.unique(np.concatenate([x for _, x in items])) if items else np.empty(0, np.uint64))

        def count(batches, vocabulary=vocabulary):
            for pdf in batches:
                for terms, counts in zip(pdf["terms"], pdf["counts"], strict=True):
                    t = np.cumsum(unsqueeze(terms, np.uint64), dtype=np.uint64)
                    own = np.isin(t, vocabulary.value, assume_unique=True)
                    yield pd.DataFrame({"term": signed(t[own]), "n": unsqueeze(counts, np.uint32)[own].astype(np.int64)})

        counted = index.select("terms", "counts").mapInPandas(lean(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # no more rows than the pass has words
        tests = spark.sparkContext.broadcast(make_tests(items, {r["term"] & (2**64 - 1): r["n"] for r in counted}, p))

        def run(batches, tests=tests):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    g = Segment.load(row.docs, row.bounds, row.terms, row.counts, row.positions)
                    yield pd.DataFrame(search(g, tests.value, p), columns=["doc_id", "item_id", "kind", "item_from", "item_to", "doc_from", "doc_to"])

        found = index.drop("segment").mapInPandas(lean(run), MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    return find_matches(build_index(docs, p), benchmark, p)


def reject(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """docs without the documents that hold a phrase of the benchmark or come near one."""
    name = free_name("leaked", docs.columns)
    found = leaks(docs, benchmark, p).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
