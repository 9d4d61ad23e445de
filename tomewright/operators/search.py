"""Boolean search and BM25 ranking."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.functions.scoring import bm25
from tomewright.functions.text import analyze, ascii_tokens, unicode_tokens
from tomewright.plans.boolean import Query, parse
from tomewright.sources.paths import stored


class AccessPolicy(Protocol):
    """Extension point: asked before a search runs."""

    def verify_access(self, subject: str, action: str, target: str) -> bool: ...

    def log_audit(self, subject: str, action: str, allowed: bool) -> None: ...


class Transport(Protocol):
    """Extension point: sends a query to other sites and gives each one's hits as JSON rows of doc_id and score."""

    def broadcast_query(self, query_json: str) -> list[str]: ...


def remote_hits(spark: SparkSession, transport: Transport, query: str, limit: int) -> DataFrame:
    """(doc_id, score) of other sites. An answer that can't be read counts as none."""
    asked = json.dumps({"query_id": f"q-{zlib.crc32(query.encode()):08x}", "query_text": query, "limit": limit})
    rows = []
    for answer in transport.broadcast_query(asked):
        try:
            rows += [(str(h["doc_id"]), float(h["score"])) for h in json.loads(answer)]
        except (ValueError, KeyError, TypeError):
            continue
    return spark.createDataFrame(rows, "doc_id string, score double")


def scan_condition(query: Query, text: str = "text") -> Column:
    """The query as a condition on the text column: one pass, no join."""
    # the lambda's variable holds the tokens, so that a text is split once and not once a word
    held = F.transform(F.array(ascii_tokens(text)), lambda tokens: query.column(lambda w: F.array_contains(tokens, w)))
    return F.coalesce(F.get(held, 0), F.lit(False))


def matching_by_scan(docs: DataFrame, query: Query | str) -> DataFrame:
    """Rows of docs that match."""
    return docs.where(scan_condition(parse(query) if isinstance(query, str) else query))


def matching_by_joins(posted: DataFrame, query: Query | str) -> DataFrame:
    """doc_id of the documents that match, by semi and anti joins over (term, doc_id)."""
    return (parse(query) if isinstance(query, str) else query).documents(posted)


def matching_in_one_pass(posted: DataFrame, query: Query | str) -> DataFrame:
    """doc_id of the documents that match, by one aggregation of the postings of the query's words.
    A document without any of the words can't match, as NOT has two sides."""
    query = parse(query) if isinstance(query, str) else query
    words = query.words()
    if not words:
        return posted.select("doc_id").limit(0)
    held = posted.where(F.col("term").isin(words)).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == w).alias(f"w{i}") for i, w in enumerate(words)])
    return held.where(query.column(lambda w: F.col(f"w{words.index(w)}"))).select("doc_id")


def select_documents(docs: DataFrame, query: Query, limit: int | None = None) -> DataFrame:
    """Matching documents by ascending doc_id."""
    found = matching_by_scan(docs, query).orderBy("doc_id")
    return found if limit is None else found.limit(max(0, limit))


def _times_in(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def scored(docs: DataFrame, query: str, *keys: str, stats: DataFrame | None = None, length_norm: bool = False, filtered: bool = True) -> DataFrame:
    """(keys, doc_id, score) of the documents that match the query.

    Every analyzed word of the query scores, once for each time it stands there. filtered:
    only documents that satisfy the query as a boolean expression; without length_norm
    every document counts as one of mean length. Texts are tokenized once: what the query
    needs of a document goes to a narrow table, from which frequencies and scores are taken.
    """
    times = Counter(analyze(query))
    if not times:
        return docs.select(*keys, "doc_id", F.lit(0.0).alias("score")).limit(0)
    # the lambda's variable holds the tokens, so that a text is split once and not once a word
    counted = lambda t: F.struct(F.coalesce(F.size(t), F.lit(0)).alias("length"), *[F.coalesce(_times_in(t, w), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(times)])
    held = F.get(F.transform(F.array(unicode_tokens("text")), counted), 0)
    matches = scan_condition(parse(query)) if filtered else F.lit(True)
    every = stored(docs.select(*keys, "doc_id", held.alias("held"), matches.alias("matches")).select(*keys, "doc_id", "held.*", "matches"), "counts")
    frequencies = [F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(times))]
    if stats is None:
        frequencies += [F.count("*").alias("total_docs"), (F.sum("length").cast("double") / F.count("*")).alias("avg_doc_len")]
    table = every.groupBy(*keys).agg(*frequencies) if keys else every.agg(*frequencies)
    if stats is not None:
        table = table.join(stats, list(keys)) if keys else table.crossJoin(stats)
    hit = F.lit(False)
    for i in range(len(times)):
        hit = hit | (F.col(f"tf{i}") > 0)
    mine = every.where(F.col("matches") & hit)
    joined = mine.join(F.broadcast(table), list(keys)) if keys else mine.crossJoin(F.broadcast(table))  # one row a key
    length = F.col("length") if length_norm else F.col("avg_doc_len")
    total = sum((n * bm25(F.col(f"tf{i}"), length, F.col("avg_doc_len"), F.col("total_docs"), F.col(f"df{i}")) for i, n in enumerate(times.values())), F.lit(0.0))
    return joined.select(*keys, "doc_id", total.alias("score"))


def top(hits: DataFrame, limit: int) -> DataFrame:
    """Highest scores first, ties by doc_id; a limit of 0 or less gives all."""
    ordered = hits.orderBy(F.desc("score"), F.asc("doc_id"))
    return ordered.limit(limit) if limit > 0 else ordered


def search(docs: DataFrame, query: str, limit: int = 10, stats: DataFrame | None = None, length_norm: bool = False) -> DataFrame:
    """(doc_id, score): ranked search of one corpus."""
    return top(scored(docs, query, stats=stats, length_norm=length_norm), limit)


def score_postings(frequencies: DataFrame, stats: DataFrame, query: str, matching: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) from a stored index (term, doc_id, tf) and one row of corpus statistics: reads the
    postings of the query's words alone. matching: doc_id of the documents that count."""
    times = Counter(analyze(query))
    hit = frequencies.where(F.col("term").isin(list(times)))
    if matching is not None:
        hit = hit.join(matching.select("doc_id"), "doc_id", "left_semi")
    counted = frequencies.where(F.col("term").isin(list(times))).groupBy("term").agg(F.count("*").alias("df"))
    named = F.create_map(*[F.lit(x) for pair in times.items() for x in pair]) if times else F.create_map().cast("map<string,int>")
    joined = hit.join(F.broadcast(counted), "term").crossJoin(F.broadcast(stats))  # a row a query word, and one row
    score = named[F.col("term")] * bm25(F.col("tf"), F.col("avg_doc_len"), F.col("avg_doc_len"), F.col("total_docs"), F.col("df"))
    return joined.groupBy("doc_id").agg(F.sum(score).alias("score"))


def scatter_gather(docs: DataFrame, query: str, limit: int, shard: str, subject: str = "", policy: AccessPolicy | None = None, remote: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): every shard ranks by its own statistics and sends its best `limit`; the best of all remain.
    Hits of other sites (remote) are added as they come, without removing repeats."""
    if policy is not None:
        allowed = policy.verify_access(subject, "search", query)
        policy.log_audit(subject, "search", allowed)
        if not allowed:
            raise PermissionError("security policy validation failure: search access denied")
    hits = scored(docs, query, shard)
    if limit > 0:
        best = Window.partitionBy(shard).orderBy(F.desc("score"), F.asc("doc_id"))
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    hits = hits.select("doc_id", "score")
    return top(hits if remote is None else hits.unionByName(remote.select("doc_id", "score")), limit)
