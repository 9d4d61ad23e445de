"""Catalogue: every operator applied to the driver's tables, with the same question as SQL.

Mapping: documents are the corpus and lang its shard; events are a version log and a
write-ahead log (event_id the transaction or the order, user_id the key, event_type the
value, `error` a tombstone); customer, part and orders are keyed sets.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import codec, keys
from tomewright.functions.text import STOP_WORDS, ascii_tokens, unicode_tokens
from tomewright.operators import execute, index, joins, log, metrics, ring, search, sets, versions
from tomewright.plans.boolean import parse
from tomewright.plans.commands import parse_command
from tomewright.sources import objects
from tomewright.sources.indexed import IndexedDocuments
from tomewright.sources.paths import scratch, stored
from tomewright.sources.version_store import VersionStore
from tomewright.streaming import log_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-02-06 06:00:00"
#: The transaction of a reader who began in the middle of the log.
READER = "(SELECT max(event_id) // 2 FROM events)"
ASCII = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
UNICODE = rf"list_filter(list_transform(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}]+'), lambda x: lower(x)), lambda x: strlen(x) > 1 AND x NOT IN ({STOP}))"
POSTINGS = f"postings AS (SELECT doc_id, unnest(list_distinct({ASCII})) AS term FROM documents)"
TF = f"tokens AS (SELECT doc_id, lang, unnest({UNICODE}) AS term FROM documents), tf AS (SELECT lang, doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL)"
LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS txn_id, event_type AS value, event_type = 'error' AS deleted, CASE WHEN event_type IN ('view', 'click') THEN ts + INTERVAL 7 DAY END AS expires_at FROM events)"
NEWEST = "newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC) AS rn FROM log)"
ALIVE = f"rn = 1 AND NOT deleted AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"
WAL = """wal AS (SELECT event_id, CAST(floor(event_id / 3) AS BIGINT) AS txn_id, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'abort' ELSE 'update' END AS kind,
 CAST(user_id AS VARCHAR) AS key, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old_value, event_type AS new_value FROM events),
sized AS (SELECT *, 49 + strlen(key) + coalesce(strlen(old_value), 0) + strlen(new_value) AS size FROM wal),
lsns AS (SELECT *, CAST(sum(size) OVER (ORDER BY event_id) - size AS BIGINT) AS lsn FROM sized)"""
ENDED = "ended AS (SELECT txn_id, max(lsn) AS last_lsn, bool_or(kind IN ('commit', 'abort')) AS ended FROM lsns GROUP BY txn_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def reader_of(spark, sf_dir) -> int:
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 2


def docs_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def version_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    expires = F.when(kind.isin("view", "click"), F.col("ts") + F.expr("INTERVAL 7 DAYS")).cast("timestamp")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("txn_id"), F.lit(0).cast("bigint").alias("seq"), kind.alias("value"), expires.alias("expires_at"), (kind == "error").alias("deleted"))


def wal_of(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "signup", "abort").otherwise("update")
    writes = versions.before_images(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("txn_id"), F.lit(0).alias("seq"), F.col("event_type").alias("value")))
    rows = writes.join(e.select(F.col("event_id").alias("txn_id"), kind.alias("kind")), "txn_id")
    named = rows.select(F.col("txn_id").alias("event_id"), F.floor(F.col("txn_id") / 3).alias("txn_id"), "kind", "key", "old_value", F.col("value").alias("new_value"))
    return log.with_lsn(named, log.record_size(F.col("key"), F.col("old_value"), F.col("new_value")), "event_id", F.shiftright("event_id", index.PART_BITS))


# --- tokenizers and indexes


@query(f"SELECT doc_id, CAST(len({ASCII}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({ASCII})) AS BIGINT) AS n_distinct, md5(array_to_string({ASCII}, ' ')) AS digest FROM documents")
def tokenize_ascii(spark, sf_dir):
    t = docs_of(spark, sf_dir).select("doc_id", ascii_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len({UNICODE}) AS BIGINT) AS n_tokens, md5(array_to_string({UNICODE}, ' ')) AS digest FROM documents")
def tokenize_unicode(spark, sf_dir):
    t = docs_of(spark, sf_dir).select("doc_id", unicode_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {POSTINGS} SELECT term, doc_id FROM postings")
def postings_build(spark, sf_dir):
    return index.postings(docs_of(spark, sf_dir))


@query(f"WITH {POSTINGS} SELECT term, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM postings GROUP BY term")
def postings_lists(spark, sf_dir):
    lists = index.postings_lists(index.postings(docs_of(spark, sf_dir)))
    return lists.select("term", F.size("doc_ids").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",")).alias("digest"))


@query(f"WITH {POSTINGS} SELECT doc_id FROM postings WHERE term = 'ated'")
def postings_fetch(spark, sf_dir):
    return index.fetch_postings(index.postings(docs_of(spark, sf_dir)), "ated")


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY term")
def term_doc_freq(spark, sf_dir):
    return index.document_frequencies(index.postings(docs_of(spark, sf_dir)))


@query(f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return index.term_frequencies(docs_of(spark, sf_dir))


@query(f"WITH {POSTINGS} SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS delta FROM postings")
def postings_delta(spark, sf_dir):
    return index.delta_encode(index.postings(docs_of(spark, sf_dir)))


@query(f"WITH {POSTINGS} SELECT term, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS position, doc_id FROM postings")
def postings_delta_decode(spark, sf_dir):
    gaps = index.delta_encode(index.postings(docs_of(spark, sf_dir)))
    placed = index.numbered(gaps)
    return index.delta_decode(placed.select("term", "position", "delta"))


@query(f"WITH {TF} SELECT term, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) / 256) AS INTEGER) AS chunk_id, doc_id, tf FROM tf")
def postings_chunks(spark, sf_dir):
    return index.chunked(index.term_frequencies(docs_of(spark, sf_dir), by_term=True))


@query(f"WITH {TF}, c AS (SELECT term, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) / 256) AS INTEGER) AS chunk_id, tf FROM tf) SELECT 'term:' || term || ':chunk:' || chunk_id AS chunk_key, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM c GROUP BY term, chunk_id")
def postings_chunk_rows(spark, sf_dir):
    rows = index.chunk_rows(index.term_frequencies(docs_of(spark, sf_dir), by_term=True))
    total = F.aggregate("postings", F.lit(0.0), lambda a, x: a + x["tf"])
    return rows.select(keys.chunk_key(F.col("term"), F.col("chunk_id")).alias("chunk_key"), F.size("postings").cast("bigint").alias("n"), total.cast("bigint").alias("tf"))


@query(f"""WITH {POSTINGS}, d AS (SELECT term, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS delta FROM postings),
s AS (SELECT term, count(*) AS postings, CAST(sum(CASE WHEN delta < 128 THEN 1 WHEN delta < 16384 THEN 2 WHEN delta < 2097152 THEN 3 WHEN delta < 268435456 THEN 4 ELSE 5 END) + 4 AS BIGINT) AS bytes FROM d GROUP BY term)
SELECT term, postings, bytes, CAST(sum(bytes) OVER (ORDER BY term COLLATE "binary") - bytes AS BIGINT) AS "offset" FROM s""".replace(' COLLATE "binary"', ""))
def segment_dictionary(spark, sf_dir):
    return index.segment_dictionary(index.postings(docs_of(spark, sf_dir)))


@query(f"SELECT count(*) AS total_docs, round(CAST(sum(len({UNICODE})) AS DOUBLE) / count(*), 6) AS avg_doc_len FROM documents")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(docs_of(spark, sf_dir)).select("total_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


@query(f"SELECT lang AS shard, doc_id, count(*) OVER w AS documents, CAST(sum(len({UNICODE})) OVER w AS BIGINT) AS tokens FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)")
def running_doc_len(spark, sf_dir):
    return index.running_lengths(docs_of(spark, sf_dir), F.col("lang"))


# --- boolean search


def _holds(word: str) -> str:
    return f"list_contains(t, '{word}')"


def _boolean(condition: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, {ASCII} AS t FROM documents) WHERE {condition}"


THAT, WAS, ATED, ING = _holds("that"), _holds("was"), _holds("ated"), _holds("ing")


@query(_boolean(THAT))
def bool_term(spark, sf_dir):
    return search.matching_by_scan(docs_of(spark, sf_dir), "that").select("doc_id")


def _postings_of(spark, sf_dir, query: str) -> DataFrame:
    """The postings of the query's words, from one pass over the texts however many sides read them."""
    return stored(index.postings(docs_of(spark, sf_dir), words=parse(query).words()), "postings")


@query(_boolean(f"{THAT} AND {WAS}"))
def bool_and(spark, sf_dir):
    return search.matching_by_joins(_postings_of(spark, sf_dir, "that AND was"), "that AND was")


@query(_boolean(f"{ATED} OR {WAS}"))
def bool_or(spark, sf_dir):
    return search.matching_by_joins(_postings_of(spark, sf_dir, "ated OR was"), "ated OR was")


@query(_boolean(f"{THAT} AND NOT {ATED}"))
def bool_not(spark, sf_dir):
    return search.matching_by_joins(_postings_of(spark, sf_dir, "that NOT ated"), "that NOT ated")


@query(_boolean(f"({THAT} OR {WAS}) AND NOT {ATED} AND {ING}"))
def bool_nested(spark, sf_dir):
    return search.matching_in_one_pass(index.postings(docs_of(spark, sf_dir), words=parse(q := "((that OR was) NOT ated) AND ing").words()), q)


@query(_boolean(f"{ATED} OR ({THAT} AND {WAS}) AND NOT {ING}"))
def bool_precedence(spark, sf_dir):
    return search.matching_in_one_pass(index.postings(docs_of(spark, sf_dir), words=parse(q := "ated OR that AND was NOT ing").words()), q)


@query(_boolean(f"{ATED} AND {WAS}"))
def bool_implicit_and(spark, sf_dir):
    return search.matching_by_scan(docs_of(spark, sf_dir), "ated was").select("doc_id")


# --- commands


@query(f"SELECT doc_id, text FROM documents WHERE list_contains({ASCII}, 'that') AND list_contains({ASCII}, 'was') ORDER BY doc_id LIMIT 100")
def command_select(spark, sf_dir):
    s = parse_command("SELECT * FROM documents WHERE that and was")
    return execute.selected(docs_of(spark, sf_dir).select("doc_id", "text"), s)


@query(f"SELECT doc_id, text FROM documents WHERE (list_contains({ASCII}, 'that') OR list_contains({ASCII}, 'was')) AND NOT list_contains({ASCII}, 'ated') ORDER BY doc_id LIMIT 20")
def command_select_limit(spark, sf_dir):
    s = parse_command("SELECT * FROM documents WHERE (that OR was) NOT ated LIMIT 20")
    return execute.selected(docs_of(spark, sf_dir).select("doc_id", "text"), s)


@query(f"SELECT d.doc_id, d.text, l.doc_id AS right_doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE list_contains({ASCII}, 'that') ORDER BY d.doc_id LIMIT 50")
def command_select_join(spark, sf_dir):
    s = parse_command("SELECT * FROM documents JOIN labels ON documents.doc_id = labels.doc_id WHERE that LIMIT 50")
    return execute.selected(docs_of(spark, sf_dir).select("doc_id", "text"), s, table(spark, sf_dir, "labels"))


@query("SELECT doc_id, text FROM documents WHERE doc_id <> 7 UNION ALL SELECT 7, 'it''s new'")
def command_insert(spark, sf_dir):
    return execute.inserted(docs_of(spark, sf_dir), parse_command("INSERT INTO documents VALUES (7, 'it''s new')"))


@query(f"SELECT doc_id, CASE WHEN list_contains({ASCII}, 'ated') THEN 'changed' ELSE text END AS text FROM documents")
def command_update(spark, sf_dir):
    return execute.updated(docs_of(spark, sf_dir).select("doc_id", "text"), parse_command("UPDATE documents SET text = 'changed' WHERE ated"))


@query(f"SELECT doc_id, text FROM documents WHERE NOT (list_contains({ASCII}, 'that') AND list_contains({ASCII}, 'was'))")
def command_delete(spark, sf_dir):
    return execute.deleted(docs_of(spark, sf_dir).select("doc_id", "text"), parse_command("DELETE FROM documents WHERE that AND was"))


# --- ranking


def _ranked(length: str, condition: str, words: list[str], limit: int, key: str = "") -> str:
    """SQL of BM25 over words, one score a word."""
    part, join_key = ("GROUP BY lang", "AND s.lang = f.lang") if key else ("", "")
    names = ", ".join(f"'{w}'" for w in words)
    own = "lang, " if key else ""
    return f"""WITH {TF},
s AS (SELECT {own}count(*) AS n, CAST(sum(len({UNICODE})) AS DOUBLE) / count(*) AS avgdl FROM documents {part}),
f AS (SELECT {own}term, count(*) AS df FROM tf WHERE term IN ({names}) GROUP BY {own}term),
dl AS (SELECT doc_id, len({UNICODE}) AS dl FROM documents),
ok AS (SELECT doc_id FROM (SELECT doc_id, {ASCII} AS t FROM documents) WHERE {condition}),
r AS (SELECT tf.lang, tf.doc_id, sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * {length} / s.avgdl))) AS score
 FROM tf JOIN f ON f.term = tf.term {"AND f.lang = tf.lang" if key else ""} JOIN s ON true {join_key} JOIN dl ON dl.doc_id = tf.doc_id JOIN ok ON ok.doc_id = tf.doc_id GROUP BY tf.lang, tf.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY {"lang" if key else "1"} ORDER BY score DESC, doc_id) AS rn FROM r)
SELECT doc_id, round(score, 6) AS score FROM k WHERE rn <= {limit} ORDER BY k.score DESC, doc_id LIMIT {limit}"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(_ranked("s.avgdl", f"{THAT} AND {WAS}", ["that", "was"], 10))
def bm25_topk(spark, sf_dir):
    return _rounded(search.search(docs_of(spark, sf_dir), "that was", 10))


@query(_ranked("s.avgdl", f"{THAT} AND {WAS}", ["that", "was"], 10))
def bm25_index_topk(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    matching = search.matching_in_one_pass(index.postings(docs, words=["that", "was"]), "that was")
    frequencies = stored(index.term_frequencies(docs), "index")
    return _rounded(search.top(search.score_postings(frequencies, index.corpus_stats(docs), "that was", matching), 10))


@query(_ranked("dl.dl", f"{THAT} AND {WAS}", ["that", "was"], 10))
def bm25_length_norm_topk(spark, sf_dir):
    return _rounded(search.search(docs_of(spark, sf_dir), "that was", 10, length_norm=True))


@query(_ranked("dl.dl", f"({THAT} OR {WAS}) AND NOT {ATED}", ["that", "or", "was", "not", "ated"], 25))
def bm25_filtered_topk(spark, sf_dir):
    return _rounded(search.search(docs_of(spark, sf_dir), "(that OR was) NOT ated", 25, length_norm=True))


@query(_ranked("s.avgdl", f"{THAT} OR {ATED}", ["that", "or", "ated"], 15, key="lang"))
def scatter_gather_topk(spark, sf_dir):
    return _rounded(search.scatter_gather(docs_of(spark, sf_dir), "that OR ated", 15, "lang"))


# --- version log


@query(f"WITH {LOG}, {NEWEST} SELECT key, value FROM newest WHERE key = '1' AND {ALIVE}")
def kv_point_read(spark, sf_dir):
    return versions.read_key(version_log(spark, sf_dir), "1", NOW).select("key", "value")


@query(f"WITH {LOG.replace('FROM events', f'FROM events WHERE event_id <= {READER}')}, {NEWEST} SELECT key, txn_id, value FROM newest WHERE {ALIVE}")
def kv_snapshot_read(spark, sf_dir):
    return versions.snapshot(version_log(spark, sf_dir), NOW, upto=reader_of(spark, sf_dir)).select("key", "txn_id", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT key, txn_id, value FROM newest WHERE rn = 1 AND NOT deleted AND expires_at <= TIMESTAMP '{NOW}'")
def kv_ttl_expired(spark, sf_dir):
    gone = ~F.col("deleted") & (F.col("expires_at") <= versions.as_time(NOW))
    return versions.newest(version_log(spark, sf_dir)).where(gone).select("key", "txn_id", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT key, txn_id FROM newest WHERE rn = 1 AND deleted")
def kv_tombstone_scan(spark, sf_dir):
    return versions.newest(version_log(spark, sf_dir)).where("deleted").select("key", "txn_id")


@query(f"WITH {LOG}, {NEWEST} SELECT key, value FROM newest WHERE starts_with(key, '1') AND {ALIVE} ORDER BY key")
def kv_prefix_scan(spark, sf_dir):
    return versions.scan_prefix(version_log(spark, sf_dir), "1", NOW).select("key", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT key, value FROM newest WHERE key BETWEEN '12' AND '5' AND {ALIVE} ORDER BY key")
def kv_range_scan(spark, sf_dir):
    return versions.scan_range(version_log(spark, sf_dir), "12", "5", NOW).select("key", "value")


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#') ORDER BY 1")
def tree_scan_ordered(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return rows.where(keys.has_prefix(F.col("key"), "Customer#")).orderBy("key")


@query(f"WITH {LOG}, {NEWEST} SELECT key, txn_id, value FROM newest WHERE {ALIVE}")
def kv_compaction(spark, sf_dir):
    return versions.compacted(version_log(spark, sf_dir), NOW).select("key", "txn_id", "value")


@query(f"WITH {LOG} SELECT key, txn_id, value, lag(value) OVER (PARTITION BY key ORDER BY txn_id) AS old_value FROM log")
def kv_before_image(spark, sf_dir):
    return versions.before_images(version_log(spark, sf_dir)).select("key", "txn_id", "value", "old_value")


@query("SELECT CAST(user_id AS VARCHAR) AS name, event_type AS field, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id, event_type")
def hash_get_all(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = keys.hash_key(F.col("user_id").cast("string"), F.col("event_type"))
    rows = e.select(key.alias("key"), F.col("event_id").alias("txn_id"), F.lit(0).alias("seq"), F.col("event_id").cast("string").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(False).alias("deleted"))
    live = versions.snapshot(rows, NOW)
    return live.select(F.split_part("key", F.lit(":"), F.lit(2)).alias("name"), F.split_part("key", F.lit(":"), F.lit(3)).alias("field"), "value")


@query("SELECT event_type AS field, CAST(max(event_id) AS VARCHAR) AS value FROM events WHERE user_id = 8 GROUP BY event_type")
def command_hset(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(keys.hash_key(F.col("user_id").cast("string"), F.col("event_type")).alias("key"), F.col("event_id").alias("txn_id"), F.lit(0).alias("seq"), F.col("event_id").cast("string").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(False).alias("deleted"))
    return versions.hash_fields(rows, "8", NOW)


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS txn_id FROM events WHERE event_id > {READER} AND event_id <> {READER} + 50 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id")
def occ_conflicts(spark, sf_dir):
    whole, reader = version_log(spark, sf_dir), reader_of(spark, sf_dir)
    return versions.conflicts(whole.where("value = 'signup'").select("key"), whole, reader, reader + 50)


# --- joins and sets


@query("SELECT c_custkey AS key, c_name AS left_value, p_name AS right_value FROM customer JOIN part ON c_custkey = p_partkey")
def merge_join_unique(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return joins.merge_join(a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")))


@query("""WITH a AS (SELECT o_custkey AS key, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
b AS (SELECT user_id AS key, event_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT a.key, a.v AS left_value, b.v AS right_value FROM a JOIN b ON a.key = b.key AND a.rn = b.rn""")
def merge_join_zip(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return joins.merge_join_zip(a, table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value")), F.shiftright("value", index.PART_BITS))


def _ids(spark, sf_dir, *words: str) -> list[DataFrame]:
    """The ids of each word's documents, from one pass over the texts."""
    posted = stored(index.postings(docs_of(spark, sf_dir), words=list(words)), "postings")
    return [posted.where(F.col("term") == w).select("doc_id") for w in words]


@query("SELECT DISTINCT l_orderkey >> 16 AS high, CAST(l_orderkey & 65535 AS INTEGER) AS low FROM lineitem")
def bitmap_chunks(spark, sf_dir):
    return sets.chunks(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem")
def bitmap_from_chunks(spark, sf_dir):
    return sets.from_chunks(bitmap_chunks(spark, sf_dir))


@query(_boolean(f"{THAT} AND {WAS}"))
def bitmap_intersect(spark, sf_dir):
    return sets.intersect(*_ids(spark, sf_dir, "that", "was"))


@query(_boolean(f"{THAT} OR {ATED}"))
def bitmap_union(spark, sf_dir):
    return sets.union(*_ids(spark, sf_dir, "that", "ated"))


@query(_boolean(f"{WAS} AND NOT {ATED}"))
def bitmap_difference(spark, sf_dir):
    return sets.difference(*_ids(spark, sf_dir, "was", "ated"))


@query("SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) AS both_flags, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag IN ('R', 'A')) AS either_flag")
def bitmap_len(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    a, b = (sets.bitmaps(line.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("doc_id"))) for f in "RA")
    both, either = sets.size(sets.bitmap_intersect(a, b)), sets.size(sets.bitmap_union(a, b))
    return both.withColumnRenamed("size", "both_flags").crossJoin(either.withColumnRenamed("size", "either_flag"))


# --- write-ahead log


@query(f"WITH {WAL} SELECT event_id, lsn FROM lsns")
def wal_lsn(spark, sf_dir):
    return wal_of(spark, sf_dir).select("event_id", "lsn")


@query(f"WITH {WAL} SELECT event_id, txn_id, lag(lsn) OVER (PARTITION BY txn_id ORDER BY lsn) AS prev_lsn FROM lsns")
def wal_prev_lsn(spark, sf_dir):
    return log.with_previous(wal_of(spark, sf_dir)).select("event_id", "txn_id", "prev_lsn")


@query(f"WITH {WAL}, {ENDED} SELECT txn_id, last_lsn FROM ended WHERE NOT ended")
def wal_analysis(spark, sf_dir):
    return log.analysis(wal_of(spark, sf_dir))


@query(f"WITH {WAL}, {ENDED} SELECT (SELECT max(txn_id) FROM lsns) AS max_txn, (SELECT max(last_lsn) FROM ended WHERE NOT ended) AS last_loser_lsn")
def wal_high_water(spark, sf_dir):
    return log.high_water(wal_of(spark, sf_dir))


@query(f"WITH {WAL} SELECT key, max(lsn) AS lsn, arg_max(new_value, lsn) AS value FROM lsns WHERE kind = 'update' AND txn_id IN (SELECT txn_id FROM lsns WHERE kind = 'commit') GROUP BY key")
def wal_redo(spark, sf_dir):
    return log.redo(wal_of(spark, sf_dir))


@query(f"WITH {WAL}, {ENDED}, u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn) AS rn FROM lsns WHERE kind = 'update' AND txn_id IN (SELECT txn_id FROM ended WHERE NOT ended)) SELECT key, lsn, old_value AS value FROM u WHERE rn = 1")
def wal_undo(spark, sf_dir):
    return log.undo(wal_of(spark, sf_dir))


@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def wal_micro_batch(spark, sf_dir):
    folder = scratch(spark, "micro-batch")
    stream = log_stream.log_source(spark, f"{sf_dir}/events.[p]arquet", table(spark, sf_dir, "events").schema)
    log_stream.group_commit(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    rows = log_stream.committed(spark, f"{folder}/log")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


# --- objects, hashing, codecs, metrics


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def object_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("o"))
    return rows.select("event_id", "o.k")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def object_roundtrip(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return objects.from_json_rows(objects.to_json_rows(customers, "c_custkey"), customers.schema)


_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (7 - i)}" for i in range(8))
_RING = f"ring AS (SELECT CAST({_HEX} AS BIGINT) AS hash, node_id FROM (SELECT sha256(n_name || '#' || i) AS h, n_name AS node_id FROM nation, range(0, 64) r(i)))"


@query(f"WITH {_RING} SELECT hash, node_id FROM ring")
def ring_tokens(spark, sf_dir):
    return ring.ring_tokens(table(spark, sf_dir, "nation").select(F.col("n_name").alias("node_id")))


@query(f"WITH {_RING}, k AS (SELECT key, CAST({_HEX} AS BIGINT) AS hash FROM (SELECT c_name AS key, sha256(c_name) AS h FROM customer)), m AS (SELECT key, (SELECT min(ring.hash) FROM ring WHERE ring.hash >= k.hash) AS at FROM k) SELECT key, r.node_id FROM m JOIN (SELECT hash, min(node_id) AS node_id FROM ring GROUP BY hash) r ON r.hash = coalesce(m.at, (SELECT min(hash) FROM ring))")
def ring_owner(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node_id"))
    return ring.owners(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")), ring.ring_tokens(nodes))


@query("""WITH c AS (SELECT doc_id, unnest(x) AS ch, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS x FROM documents)),
g AS (SELECT doc_id, i, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS grp FROM c),
r AS (SELECT doc_id, ch, grp, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, sum((n // 255) * 3 + CASE WHEN n % 255 >= 4 THEN 3 ELSE n % 255 END) AS size FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.size, 0) AS BIGINT) AS size FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""")
def rle_size(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", codec.run_length_size(F.col("text")).alias("size"))


@query("""WITH b AS (SELECT doc_id, length(regexp_replace(text, '[^a-z0-9 ]', '', 'g')) AS n7, length(regexp_replace(text, '[^A-Z"_:]', '', 'g')) AS n8, strlen(text) AS n FROM documents)
SELECT doc_id, CAST(n7 * 7 + n8 * 8 + (n - n7 - n8) * 9 AS BIGINT) AS bits, CAST(6 + ceil((n7 * 7 + n8 * 8 + (n - n7 - n8) * 9) / 8) AS BIGINT) AS size FROM b""")
def huffman_bits(spark, sf_dir):
    bits = codec.prefix_code_bits(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", bits.alias("bits"), codec.packed_size(bits).alias("size"))


@query("""WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents)
SELECT CASE WHEN x = '20' OR x BETWEEN '30' AND '39' OR x BETWEEN '61' AND '7A' THEN 7 WHEN x BETWEEN '41' AND '5A' OR x IN ('22', '5F', '3A') THEN 8 ELSE 9 END AS length, count(*) AS n FROM b GROUP BY 1""")
def code_lengths(spark, sf_dir):
    """Bytes of all texts by the length of their code."""
    counted = docs_of(spark, sf_dir).select(codec.code_length_counts(F.col("text")).alias("c")).agg(*[F.sum(f"c.n{k}").alias(f"n{k}") for k in (7, 8, 9)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("length"), F.col(f"n{k}").alias("n")) for k in (7, 8, 9)])))


_BITS = "CASE WHEN {0} = 32 OR {0} BETWEEN 48 AND 57 OR {0} BETWEEN 97 AND 122 THEN 7 WHEN {0} BETWEEN 65 AND 90 OR {0} IN (34, 95, 58) THEN 8 ELSE 9 END"


@query(f"""WITH c AS (SELECT doc_id, i, i // 32700 AS block, (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS x
 FROM (SELECT doc_id, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents))),
g AS (SELECT doc_id, block, x, i - row_number() OVER (PARTITION BY doc_id, block, x ORDER BY i) AS grp FROM c),
r AS (SELECT doc_id, block, x, count(*) AS n FROM g GROUP BY doc_id, block, x, grp),
b AS (SELECT doc_id, block, sum((n // 255) * (18 + {_BITS.format("x")}) + CASE WHEN n % 255 >= 4 THEN 9 + {_BITS.format("(n % 255)")} + {_BITS.format("x")} ELSE (n % 255) * {_BITS.format("x")} END) AS bits FROM r GROUP BY doc_id, block),
p AS (SELECT doc_id, count(*) AS blocks, sum(10 + (bits + 7) // 8) AS size FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks, CAST(coalesce(size, 0) AS BIGINT) AS size, true AS same FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id""")
def block_roundtrip(spark, sf_dir):
    """Texts in run and prefix coded blocks, each behind its length, and back."""
    packed = docs_of(spark, sf_dir).select("doc_id", "text", codec.enveloped(F.col("text"), codec.BlockCodec()).alias("packed"))
    back = codec.opened(F.col("packed"), codec.BlockCodec(), strict=False).cast("string")
    n = F.octet_length("text")
    return packed.select("doc_id", F.ceil(n / codec.MAX_BLOCK).cast("bigint").alias("blocks"), (F.octet_length("packed") - 1).cast("bigint").alias("size"), (F.when(n > 0, back).otherwise(F.lit("")) == F.col("text")).alias("same"))


_VARINT = "CASE WHEN {0} < 128 THEN '' ELSE printf('%02X', {0} & 127 | 128) END || CASE WHEN {0} < 16384 THEN '' ELSE printf('%02X', {0} >> 7 & 127 | 128) END || printf('%02X', CASE WHEN {0} < 128 THEN {0} WHEN {0} < 16384 THEN {0} >> 7 ELSE {0} >> 14 END)"
_GAPS = f"{POSTINGS}, gaps AS (SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM postings)"
_LE = lambda x, n: " || ".join(f"printf('%02X', {x} >> {8 * i} & 255)" for i in range(n))


@query(f"WITH {_GAPS} SELECT term, {_LE('count(*)', 4)} || string_agg({_VARINT.format('gap')}, '' ORDER BY doc_id) AS block FROM gaps GROUP BY term")
def segment_bytes(spark, sf_dir):
    """The bytes of every term's block of a segment. Ids of these tables lie below 2**20, so a term has one block."""
    return index.segment_blocks(index.postings(docs_of(spark, sf_dir))).select("term", F.hex("block").alias("block"))


@query(f"WITH {POSTINGS} SELECT term, doc_id FROM postings")
def segment_bytes_read(spark, sf_dir):
    """Postings, written as segment bytes and read back."""
    return index.read_blocks(index.segment_blocks(index.postings(docs_of(spark, sf_dir))))


@query(f"WITH c AS (SELECT DISTINCT l_orderkey >> 16 AS high, l_orderkey & 65535 AS low FROM lineitem) SELECT high, {_LE('high', 8)} || {_LE('count(*)', 4)} || string_agg({_LE('low', 2)}, '' ORDER BY low) AS chunk FROM c GROUP BY high")
def bitmap_bytes(spark, sf_dir):
    """The bytes of a bitmap's chunks."""
    return sets.serialised_chunks(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))).select("high", F.hex("chunk").alias("chunk"))


@query("SELECT DISTINCT l_orderkey >> 16 AS high, CAST(l_orderkey & 65535 AS INTEGER) AS low FROM lineitem")
def bitmap_bytes_read(spark, sf_dir):
    return sets.read_chunks(sets.serialised_chunks(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))))


@query(f"SELECT event_id, {_LE('event_id', 8)} AS little, printf('%016X', event_id) AS big, event_id AS from_little, event_id AS from_big FROM events")
def integer_bytes(spark, sf_dir):
    coded = table(spark, sf_dir, "events").select("event_id", keys.little_endian(F.col("event_id"), 8).alias("raw"), keys.big_endian(F.col("event_id")).alias("big"))
    return coded.select("event_id", F.hex("raw").alias("little"), "big", keys.from_little_endian(F.col("raw"), 8).alias("from_little"), keys.from_big_endian(F.col("big")).alias("from_big"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS same FROM documents")
def codec_roundtrip(spark, sf_dir):
    packed = docs_of(spark, sf_dir).select("doc_id", "text", codec.enveloped(F.col("text"), codec.ZlibCodec()).alias("packed"))
    back = codec.opened(F.col("packed"), codec.ZlibCodec()).cast("string")
    return packed.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), (back == F.col("text")).alias("same"))


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


@query(f"""WITH t AS (SELECT {_crc_table()}::BIGINT[] AS t), b AS (SELECT page_id, regexp_extract_all(hex(encode(concat(url, html))), '..') AS h FROM pages),
l AS (SELECT page_id, list_transform(h, lambda x: CAST((strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS l FROM b)
SELECT page_id, xor(list_reduce(list_concat([4294967295::BIGINT], l), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS crc, true AS intact, false AS changed_intact FROM l, t""")
def page_crc(spark, sf_dir):
    """Checksums, computed by the polynomial on the other side; a page with one more byte doesn't pass."""
    crc = codec.checksum(F.col("url"), F.col("html"))
    stored_ = table(spark, sf_dir, "pages").select("page_id", crc.alias("crc"), "url", "html")
    return stored_.select("page_id", "crc", codec.intact(F.col("crc"), F.col("url"), F.col("html")).alias("intact"), codec.intact(F.col("crc"), F.col("url"), F.col("html"), F.lit("x")).alias("changed_intact"))


# --- stores


def _clock(moments: list[datetime]):
    """A clock that stands at the last of the moments."""
    return lambda: moments[-1]


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_name END AS value FROM customer
WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3 UNION ALL SELECT 'note', 'second' UNION ALL SELECT 'other', 'both'""")
def store_lifecycle(spark, sf_dir):
    """Through the version store: writes, updates, deletes, a lifetime that ends, a checkpoint, and two writes of one transaction."""
    now = [datetime(2024, 1, 1)]
    store = VersionStore(spark, scratch(spark, "store"), clock=_clock(now))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"), "c_acctbal", "c_mktsegment", "c_nationkey")
    store.write("customers", rows.select("key", "value"))
    store.write("customers", rows.where("c_nationkey = 3").select("key", "value"), ttl=timedelta(hours=1))
    store.write("customers", rows.where("c_acctbal < 0 AND c_nationkey <> 3").select("key", F.lit("owes").alias("value")), read_txn=store.snapshot_id())
    store.delete("customers", rows.where("c_mktsegment = 'BUILDING'").select("key"))
    now.append(datetime(2024, 1, 1, 2))
    store.checkpoint("customers")
    with store.transaction() as txn:
        store.write("customers", spark.createDataFrame([("note", "first"), ("other", "both")], "key string, value string"), txn=txn)
        store.write("customers", spark.createDataFrame([("note", "second")], "key string, value string"), txn=txn)
    return store.live("customers")


@query("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
h AS (SELECT max(event_id) // 2 AS h FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) FILTER (event_id <= h) AS redone, arg_min(coalesce(before, '-'), event_id) FILTER (event_id > h) AS undone FROM w, h GROUP BY user_id""")
def store_recovery(spark, sf_dir):
    """Through the store's own log: the first half of the events is committed, the second is lost; what redo and undo give for each key."""
    reader = reader_of(spark, sf_dir)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), "event_id")
    store = VersionStore(spark, scratch(spark, "store"))
    ordered = lambda x: x.repartitionByRange("key", "event_id").sortWithinPartitions("key", "event_id").select("key", "value")
    store.write("log", ordered(rows.where(F.col("event_id") <= reader)))
    try:
        with store.transaction() as txn:
            store.write("log", ordered(rows.where(F.col("event_id") > reader)), txn=txn)
            raise RuntimeError("the writer is lost")
    except RuntimeError:
        pass
    wal = stored(store.wal("log"), "wal")
    done, back = log.redo(wal).select("key", F.col("value").alias("redone")), log.undo(wal).select("key", F.coalesce("value", F.lit("-")).alias("undone"))
    return done.join(back, "key", "full")


@query(f"""SELECT doc_id, CASE WHEN list_contains({ASCII}, 'that') THEN 'changed text' ELSE text END AS text FROM documents
WHERE NOT (list_contains({ASCII}, 'was') AND NOT list_contains({ASCII}, 'that')) AND doc_id <> 7 UNION ALL SELECT 7, 'packed words' UNION ALL SELECT -1, '{{"name": "new", "sub": {{"name": "kept"}}}}'""")
def engine_commands(spark, sf_dir):
    """Commands over a store: UPDATE, DELETE, INSERT COMPRESSED, an update of one JSON field, CHECKPOINT; then all documents."""
    store = VersionStore(spark, scratch(spark, "store"))
    store.write("docs", docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value")))
    db = execute.Engine(store)
    db.execute("UPDATE docs SET text = 'changed text' WHERE that")
    db.execute("DELETE FROM docs WHERE was")
    db.execute("INSERT COMPRESSED INTO docs VALUES (7, 'packed words')")
    store.write("docs", spark.createDataFrame([("-1", '{"name": "uniqueoldname", "sub": {"name": "kept"}}')], "key string, value string"))
    db.execute("UPDATE docs SET name = 'new' WHERE uniqueoldname")
    db.execute("CHECKPOINT")
    return db.documents("docs", compressed=True)


@query(_ranked("s.avgdl", f"{THAT} AND {WAS}", ["that", "was"], 10))
def indexed_search(spark, sf_dir):
    """Ranked search by a stored index that two inserts built; every document of the first had another text before."""
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    indexed = IndexedDocuments(VersionStore(spark, scratch(spark, "store")), "docs")
    indexed.insert(docs.select("doc_id", F.substring("text", 1, 40).alias("text")))
    indexed.insert(docs)
    return _rounded(indexed.search("that was", 10))


@query("""SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses,
round(count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'click')), 9) AS hit_ratio,
CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'signup') / count(*) FILTER (event_type = 'signup')) AS BIGINT) AS mean_flush,
CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'purchase')) AS BIGINT) AS mean_compaction,
count(*) FILTER (event_type = 'error') AS active FROM events""")
def metrics_snapshot(spark, sf_dir):
    names = {"view": "hit", "click": "miss", "signup": "flush", "purchase": "compaction", "error": "begin"}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    samples = table(spark, sf_dir, "events").select(kind.alias("kind"), F.round(F.col("value") * 100).cast("bigint").alias("amount"))
    return metrics.metrics_snapshot(samples).withColumn("hit_ratio", F.round("hit_ratio", 9))
