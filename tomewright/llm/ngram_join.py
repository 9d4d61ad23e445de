"""N-gram Jaccard self-join by MinHash banding, every candidate verified on full n-gram sets.

1. Every document's set of word n-grams is hashed; documents with equal sets form a
   class and go on as one. `bands` and `rows` are chosen from the threshold and the
   recall asked for at the threshold (recall above it is higher).
2. The classes shuffle on the hashes of their bands. A bucket is what shares one.
3. Candidate pairs are never listed. Classes get a block (the smallest class that
   they share a bucket with, cut into parts of `block` classes where it has more), and
   a bucket goes to the tile of each pair of blocks in it. A tile loads the full set of
   each of its classes once, marks the candidate pairs of all its buckets and
   verifies each pair once; a pair has one tile. So a group of thousands of near copies
   costs one load a tile and not one a pair, and no bucket is cut short.
4. A tile gives the number of links of each of its classes and a forest that joins
   what is linked, so what leaves it grows with the classes and not with the pairs.

Classes are named by a 64-bit hash of their set; two different sets share one with
probability 2**-64 a pair.

Results: `linked` gives one row a document that has links (its group and the number of
its links); `keep_one` filters documents; `similar_pairs` lists all pairs.

Defined results: null, empty and wordless texts have no n-grams and no links, and
`keep_one` keeps their rows; a text of fewer than n words has one n-gram, all of its
words; equal texts have similarity 1; repeated rows are one document; rows with one
doc_id and different n-gram sets are documents of their own, which may be linked with
each other and lie in different groups; a null doc_id takes no part in `linked` and
`similar_pairs`, while `keep_one` judges its row by the text, after all others of its
group. Of a group `keep_one` keeps one row, that of the smallest doc_id, then of the
smallest hash of the text, then of the smallest hash of the other columns. Other columns
are not touched, whatever their names; an empty table gives an empty result. Pairs have
doc_a < doc_b and come once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free_name, materialize
from .text import Words, chunks, gram_hashes, lean, mix, signed


@dataclass(frozen=True)
class JoinParams:
    n: int = 3
    threshold: float = 0.5
    recall: float = 0.95
    max_hashes: int = 256
    block: int = 256
    seed: int = 5


def recall_at(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** bands


def choose_bands(p: JoinParams) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands reach the recall at the threshold within max_hashes."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - p.recall) / math.log1p(-(p.threshold**rows)))
        if bands * rows <= p.max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too low for this recall")
    return best


def gram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text's words."""
    return np.unique(gram_hashes(hashes, min(n, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def set_name(grams: np.ndarray) -> np.uint64:
    return mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64))[0]


def band_hashes(grams: np.ndarray, factors: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band of the minima under every factor. It holds the number of its band."""
    low = np.full(len(factors), 2**32 - 1, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), 1024):
        np.minimum(low, (factors[:, None] * short[None, a : a + 1024]).min(1), out=low)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        out = mix(out + low[r::rows][:bands].astype(np.uint64))
    return out


def _sets(texts: list[str | None], n: int):
    """(place, n-gram set) of every text that has words."""
    for a, b in chunks([len(t or "") for t in texts]):
        w = Words(texts[a:b])
        for i in range(b - a):
            if w.bounds[i + 1] > w.bounds[i]:
                yield a + i, gram_set(w.hashes[w.bounds[i] : w.bounds[i + 1]], n)


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("version")).where("text IS NOT NULL")


def signatures(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, version (hash of the text), class and bands of every row with words."""
    bands, rows = choose_bands(p)
    factors = np.random.default_rng(p.seed).integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches):
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64")
            out = [(ids.iat[i], pdf["version"].iat[i], np.int64(np.uint64(set_name(g)).view(np.int64)), signed(band_hashes(g, factors, bands, rows))) for i, g in _sets(pdf["text"].tolist(), p.n)]
            yield pd.DataFrame(out, columns=["doc_id", "version", "class", "bands"]).astype({"doc_id": "Int64"})

    return _picked(docs).mapInPandas(lean(run), "doc_id long, version long, class long, bands array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, class: of the buckets with more than one class. Whole partitions are sorted at once by bucket."""

    def run(batches):
        parts = [(pdf["bucket"].to_numpy(), pdf["class"].to_numpy()) for pdf in batches]
        if not parts:
            return
        bucket, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((own, bucket))
        bucket, own = bucket[order], own[order]
        same = bucket[1:] == bucket[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        bucket, own = bucket[shared], own[shared]
        if not len(bucket):
            return
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        least = own[first][np.cumsum(first) - 1]
        for a in range(0, len(bucket), 100_000):
            yield pd.DataFrame({"bucket": bucket[a : a + 100_000], "class": own[a : a + 100_000], "least": least[a : a + 100_000]})

    spread = classes.select(F.explode("bands").alias("bucket"), "class")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, "bucket").mapInPandas(lean(run), "bucket long, class long, least long")


def _tiles(in_bucket: DataFrame, p: JoinParams) -> DataFrame:
    """tile, members, cut: the classes of a bucket that lie in the two blocks of a tile, first `cut` of the one and then those
    of the other (0: a tile of one block). Pairs within a block belong to the tile of that block alone."""
    home = in_bucket.groupBy("class").agg(F.min("least").alias("label"))
    sizes = home.groupBy("label").agg(F.count("*").alias("size"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / p.block))
    block = home.join(sizes, "label").select("class", F.xxhash64("label", F.pmod(F.xxhash64("class"), parts)).alias("block"))

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = [tuple(pdf[c].to_numpy() for c in ("bucket", "block", "class")) for pdf in batches]
        if not held:
            return
        bucket, block, own = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((own, block, bucket))
        bucket, block, own = bucket[order], block[order], own[order]
        cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])]))
        end = np.append(cut[1:], len(bucket))
        rows, seen = [], set()
        i = 0
        while i < len(cut):
            j = i + 1
            while j < len(cut) and bucket[cut[j]] == bucket[cut[i]]:
                j += 1
            for x in range(i, j):
                for y in range(x, j):
                    members = own[cut[x] : end[x]] if x == y else np.concatenate([own[cut[x] : end[x]], own[cut[y] : end[y]]])
                    if len(members) < 2:
                        continue
                    ends = mix(np.array([block[cut[x]], block[cut[y]]], np.int64).view(np.uint64))
                    tile = int(signed(mix(ends[:1] + mix(ends[1:])))[0])
                    first = 0 if x == y else end[x] - cut[x]
                    if (tile, first, members.tobytes()) not in seen:
                        seen.add((tile, first, members.tobytes()))
                        rows.append((tile, members, first))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["tile", "members", "cut"])
                    rows, seen = [], set()
            i = j
        if rows:
            yield pd.DataFrame(rows, columns=["tile", "members", "cut"])

    n = int(in_bucket.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_bucket.join(block, "class").select("bucket", "block", "class").repartition(n, "bucket").mapInPandas(lean(run), "tile long, members array<long>, cut int")


@dataclass
class Verified:
    """Of one tile: classes with their weighted number of links, edges that join what is linked, and all pairs (if asked for)."""

    names: np.ndarray
    links: np.ndarray
    forest: list[tuple[int, int]]
    pairs: list[tuple[int, int, float]]


def _verify(loaded: dict[int, tuple[np.ndarray, int]], buckets: list[tuple[np.ndarray, int]], threshold: float, want: str) -> Verified:
    """loaded: the n-gram set and the documents of each class; buckets: (members, cut).
    want: `links`, `pairs`, or `groups`, for which a pair that is joined already is not verified."""
    names = np.array(sorted(loaded), np.int64)
    sets = [loaded[int(c)][0] for c in names]
    weight = np.array([loaded[int(c)][1] for c in names], np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    candidate = np.zeros((len(names), len(names)), bool)
    for members, cut in buckets:
        at = np.searchsorted(names, members)
        if cut:
            candidate[np.ix_(at[:cut], at[cut:])] = candidate[np.ix_(at[cut:], at[:cut])] = True
        else:
            candidate[np.ix_(at, at)] = True
    _, grams = np.unique(np.concatenate(sets), return_inverse=True)
    present = np.zeros(int(grams.max()) + 1, bool)
    group, out = np.arange(len(names)), Verified(names, np.zeros(len(names), np.int64), [], [])
    for i in range(len(names)):
        others = np.flatnonzero(candidate[i, i + 1 :]) + i + 1
        others = others[(np.minimum(size[others], size[i]) >= threshold * np.maximum(size[others], size[i]) - 1e-9)]
        if want == "groups":
            others = others[group[others] != group[i]]
        if not len(others):
            continue
        own = grams[start[i] : start[i] + size[i]]
        present[own] = True
        if len(others) * 4 > len(names) - i:
            shared = np.add.reduceat(present[grams[start[i] :]], start[i:] - start[i], dtype=np.int64)[others - i]
        else:
            shared = np.array([np.count_nonzero(present[grams[start[j] : start[j] + size[j]]]) for j in others])
        present[own] = False
        similarity = shared / (size[others] + size[i] - shared)
        others, similarity = others[similarity >= threshold], similarity[similarity >= threshold]
        if want == "pairs":
            out.pairs += [(int(names[i]), int(names[j]), float(s)) for j, s in zip(others, similarity, strict=True)]
            continue
        out.links[i] += weight[others].sum()
        out.links[others] += weight[i]
        for j in others:
            if group[j] != group[i]:
                out.forest.append((int(names[i]), int(names[j])))
                group[group == group[j]] = group[i]
    return out


def _classes(docs: DataFrame, p: JoinParams, want: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, version and class of every row with words, and what the tiles give: edges (class_a, class_b), links (class_a, links), and pairs."""
    rows = materialize(signatures(docs, p), "signatures")
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "version")
    classes = rows.groupBy("class").agg(F.min(own).alias("who"), F.first("bands").alias("bands"))
    in_bucket = materialize(_buckets(classes), "buckets")
    tiles = materialize(_tiles(in_bucket, p), "tiles")
    wanted = tiles.select("tile", F.explode("members").alias("class")).groupBy("class").agg(F.collect_set("tile").alias("tiles"))
    sizes = rows.where("doc_id IS NOT NULL").select("class", "doc_id").distinct().groupBy("class").agg(F.count("*").alias("n")) if want == "links" else rows.select("class", F.lit(1).cast("bigint").alias("n")).distinct()
    chosen = classes.select("class", F.col("who.doc_id").alias("doc_id"), F.col("who.version").alias("version")).join(wanted, "class").join(sizes, "class", "left")
    # the row from which the set of a class is loaded; rows that repeat it do no harm
    place = chosen.groupBy("doc_id", "version").agg(F.collect_list(F.struct("class", "tiles", F.coalesce("n", F.lit(0)).alias("n"))).alias("wanted"))

    def load(batches):
        columns = ["tile", "class", "n", "grams"]
        for pdf in batches:
            held: list[tuple] = []
            wanted = pdf["wanted"].tolist()
            for i, grams in _sets(pdf["text"].tolist(), p.n):
                name = int(np.uint64(set_name(grams)).view(np.int64))
                for w in wanted[i]:
                    if w["class"] == name:
                        held += [(tile, name, w["n"], grams.tobytes()) for tile in w["tiles"]]
                if len(held) >= 2000:
                    yield pd.DataFrame(held, columns=columns).assign(members=None, cut=0)
                    held = []
            yield pd.DataFrame(held, columns=columns).assign(members=None, cut=0)

    shape = "tile long, class long, n long, grams binary, members array<long>, cut int"
    texts = _picked(docs)
    same = texts["doc_id"].eqNullSafe(place["doc_id"]) & (texts["version"] == place["version"])
    sets = texts.join(place, same).select("text", "wanted").mapInPandas(lean(load), shape)
    none = F.lit(None)
    lists = tiles.select("tile", F.lit(0).cast("long").alias("class"), F.lit(0).cast("long").alias("n"), none.cast("binary").alias("grams"), "members", "cut")

    def frame(held: list[Verified]) -> pd.DataFrame:
        edges = np.array([e for v in held for e in v.forest], np.int64).reshape(-1, 2)
        pairs = [x for v in held for x in v.pairs]
        some = [np.flatnonzero(v.links) for v in held]
        names, links = (np.concatenate([getattr(v, f)[i] for v, i in zip(held, some, strict=True)]) for f in ("names", "links"))
        n, rest = len(names), len(edges)
        out = pd.DataFrame({"class_a": np.concatenate([names, edges[:, 0], np.array([a for a, _, _ in pairs], np.int64)])})
        for column, at, values in (("class_b", n, [*edges[:, 1], *(b for _, b, _ in pairs)]), ("links", 0, links), ("jaccard", n + rest, [x for _, _, x in pairs])):
            out[column] = pd.array([None] * len(out), "Float64" if column == "jaccard" else "Int64")
            out.loc[at : at + len(values) - 1, column] = values
        return out

    def verify(batches):
        tile, loaded, buckets = None, {}, []
        held, size = [], 0
        for pdf in batches:
            for t, c, n, g, m, cut in zip(pdf["tile"].tolist(), pdf["class"], pdf["n"], pdf["grams"], pdf["members"], pdf["cut"], strict=True):
                if t != tile:
                    if loaded:
                        held.append(_verify(loaded, buckets, p.threshold, want))
                        size += len(held[-1].names) + len(held[-1].pairs)
                        if size > 50_000:
                            yield frame(held)
                            held, size = [], 0
                    tile, loaded, buckets = t, {}, []
                if g is not None:
                    loaded[int(c)] = np.frombuffer(g, np.uint64), int(n)
                else:
                    buckets.append((np.asarray(m), int(cut)))
        if loaded:
            held.append(_verify(loaded, buckets, p.threshold, want))
        if held:
            yield frame(held)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = sets.unionByName(lists).repartition(n, "tile").sortWithinPartitions("tile").mapInPandas(lean(verify), "class_a long, class_b long, links long, jaccard double")
    return rows.select("doc_id", "version", "class"), materialize(given, "links")


def _groups(rows: DataFrame, edges: DataFrame, key) -> DataFrame:
    """class, first, kept: of every class, its least key and the least key of its group."""
    by_class = rows.groupBy("class").agg(F.min(key).alias("first"))
    roots = components(edges.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    placed = by_class.join(roots, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    return placed.join(placed.groupBy("root").agg(F.min("first").alias("kept")), "root").select("class", "first", "kept")


def linked(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, class_id, n_links: one row a document that is linked with others. class_id is the smallest doc_id of all
    that it is linked with directly or by way of others; n_links counts the documents that reach the threshold with it."""
    rows, found = _classes(docs, p, "links")
    members = rows.where("doc_id IS NOT NULL").select("doc_id", "class").distinct()
    group = _groups(members, found.where("class_b IS NOT NULL"), F.col("doc_id"))
    across = found.where("links IS NOT NULL").groupBy(F.col("class_a").alias("class")).agg(F.sum("links").alias("across"))
    within = members.groupBy("class").agg((F.count("*") - 1).alias("within"))
    table = group.join(within, "class").join(across, "class", "left").select("class", F.col("kept").alias("class_id"), (F.col("within") + F.coalesce("across", F.lit(0))).alias("n_links")).where("n_links > 0")
    return members.join(table, "class").select("doc_id", "class_id", "n_links")


def similar_pairs(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """doc_a, doc_b, jaccard of all pairs of documents that reach the threshold (of those that share a band).
    It lists every pair, so it grows with the square of a group of copies; `linked` does not."""
    rows, found = _classes(docs, p, "pairs")
    members = rows.where("doc_id IS NOT NULL").select("doc_id", "class").distinct()
    a, b = (members.select(F.col("class").alias(f"class_{x}"), F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    across = found.select("class_a", "class_b", "jaccard").join(a, "class_a").join(b, "class_b").where("doc_a <> doc_b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    many = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("class_a"))
    own = a.join(many, "class_a", "left_semi")
    inside = own.join(own.select(F.col("class_a"), F.col("doc_a").alias("doc_b")), "class_a").where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    return across.unionByName(inside).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that a node is linked with, for every node of the edges (a, b).
    Labels spread to neighbours and jump to their own label until none changes."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("seen", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = materialize(spread.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return labels


def keep_one(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """docs with one row of each group of near copies; all columns stay."""
    rows, found = _classes(docs, p, "groups")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")
    group = _groups(rows, found.where("class_b IS NOT NULL"), key)
    once = rows.groupBy("doc_id", "version", "class").agg(F.count("*").alias("times"))
    placed = once.join(group.select("class", "kept"), "class")
    stays = (F.col("kept.version") == F.col("version")) & F.col("kept.doc_id").eqNullSafe(F.col("doc_id"))
    placed = materialize(placed.select("doc_id", "version", "times", stays.alias("stays")), "decisions")
    names = [free_name(x, docs.columns) for x in ("gone_id", "gone_version")]
    of = lambda found: found.select(F.col("doc_id").alias(names[0]), F.col("version").alias(names[1]))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1]))
    left = docs.join(of(placed.where("NOT stays")), same, "left_anti")
    repeated = of(placed.where("stays AND times > 1"))
    if repeated.isEmpty():
        return left
    # rows of one doc_id and text: one of them stays
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    row, rank = free_name("row", docs.columns), F.xxhash64(*plain)
    first = left.join(repeated, same, "left_semi").groupBy(F.col("doc_id").alias(names[0]), F.xxhash64("text").alias(names[1])).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias(row))
    return left.join(repeated, same, "left_anti").unionByName(first.select(*[F.col(f"`{row}`.`{c}`") for c in docs.columns]))
