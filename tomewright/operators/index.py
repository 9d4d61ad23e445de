"""Inverted indexes: postings, frequencies, corpus statistics, chunks and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.codec import read_varints, running_totals, varint_length, varints
from tomewright.functions.keys import little_endian
from tomewright.functions.text import ascii_tokens, unicode_tokens

from .running import running_sums

CHUNK = 256
#: Ids of 2**PART_BITS in a row are ordered by one task where a key may hold most of the rows (a shard, a whole log).
#: A term holds at most one posting a document, a small share of all, so postings are ordered within their term as a whole.
PART_BITS = 20


def _along(order: str):
    """The postings of a term in order, ids that are null last."""
    return Window.partitionBy("term").orderBy(F.asc_nulls_last(order))


def postings(docs: DataFrame, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """(term, doc_id): the distinct ASCII tokens of each document, or those of them that are among words."""
    tokens = ascii_tokens(text)
    own = F.array_distinct(tokens) if words is None else F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    return docs.select("doc_id", F.explode(own).alias("term")).select("term", "doc_id")


def term_frequencies(docs: DataFrame, *keys: str, text: str = "text", by_term: bool = False) -> DataFrame:
    """(keys, doc_id, term, tf) under the Unicode analyzer. by_term: the words are shuffled by term before they are
    counted, so that what goes on by term needs no other shuffle."""
    words = docs.select(*keys, "doc_id", F.explode(unicode_tokens(text)).alias("term"))
    words = words.repartition("term") if by_term else words
    return words.groupBy(*keys, "doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(term, df) of postings without repeats."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def postings_lists(posted: DataFrame) -> DataFrame:
    """(term, doc_ids): one row a term, ids ascending; the form in which an index is stored."""
    return posted.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def write_segment(posted: DataFrame, path: str) -> None:
    """Stores postings sorted by term, so that a look-up reads the row groups of its term alone."""
    posted.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.parquet(path)


def fetch_postings(segment: DataFrame, term: str) -> DataFrame:
    """Ascending doc ids of a term; none if the term is unknown. The filter reaches the Parquet scan."""
    return segment.where(F.col("term") == term).select("doc_id").orderBy("doc_id")


def corpus_stats(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row (per key): documents and the mean number of analyzed tokens."""
    sized = docs.select(*keys, F.coalesce(F.size(unicode_tokens(text)), F.lit(0)).alias("n"))
    made = (F.count("*").alias("total_docs"), (F.sum("n").cast("double") / F.count("*")).alias("avg_doc_len"))
    return sized.groupBy(*keys).agg(*made) if keys else sized.agg(*made)


def running_lengths(docs: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """doc_id, documents and tokens so far within the key, in the order of doc_id: the mean length as documents come in."""
    sized = docs.select(key.alias("shard"), "doc_id", F.lit(1).cast("bigint").alias("one"), F.size(unicode_tokens(text)).cast("bigint").alias("n"))
    return running_sums(sized, "doc_id", F.shiftright("doc_id", PART_BITS), ["shard"], documents="one", tokens="n").select("shard", "doc_id", "documents", "tokens")


def delta_encode(posted: DataFrame) -> DataFrame:
    """(term, doc_id, delta): the gap to the id before it, the first id as it is."""
    before = F.lag("doc_id").over(_along("doc_id"))
    return posted.select("term", "doc_id", (F.col("doc_id") - F.coalesce(before, F.lit(0))).alias("delta"))


def delta_decode(gaps: DataFrame, order: str = "position") -> DataFrame:
    """(term, position, doc_id) from (term, position, delta)."""
    so_far = _along(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return gaps.select("term", order, F.sum("delta").over(so_far).alias("doc_id"))


def chunked(frequencies: DataFrame, size: int = CHUNK) -> DataFrame:
    """(term, chunk_id, doc_id, tf): postings in chunks of `size` in the order of doc_id."""
    placed = numbered(frequencies.select("term", "doc_id", "tf"))
    return placed.select("term", F.floor((F.col("position") - 1) / size).cast("int").alias("chunk_id"), "doc_id", "tf")


def numbered(posted: DataFrame) -> DataFrame:
    """Adds position: 1 for the first document of a term, and so on."""
    return posted.withColumn("position", F.row_number().over(_along("doc_id")).cast("bigint"))


def segment_blocks(posted: DataFrame) -> DataFrame:
    """(term, part, postings, block): the bytes of a segment. A block holds the 4-byte little-endian count of its postings and
    the varints of their gaps, the first one from 0; a term has one block for 2**PART_BITS ids in a row."""
    part = F.shiftright("doc_id", PART_BITS)
    ids = posted.groupBy("term", part.alias("part")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    gaps = F.transform("ids", lambda x, i: x - F.when(i > 0, F.get(F.col("ids"), i - 1)).otherwise(F.lit(0)))
    return ids.select("term", "part", F.size("ids").alias("postings"), F.concat(little_endian(F.size("ids"), 4), varints(gaps)).alias("block"))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(term, doc_id) from segment blocks."""
    gaps = blocks.select("term", read_varints(F.expr("substring(block, 5)")).alias("gaps"))
    return gaps.select("term", F.explode(running_totals(F.col("gaps"))).alias("doc_id"))


def chunk_rows(frequencies: DataFrame, size: int = CHUNK) -> DataFrame:
    """(term, chunk_id, postings): chunks as nested rows."""
    entry = F.struct("doc_id", F.col("tf").cast("double").alias("tf"))
    return chunked(frequencies, size).groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list(entry)).alias("postings"))


def segment_dictionary(posted: DataFrame) -> DataFrame:
    """(term, postings, bytes, offset) of a segment in which a term takes a 4-byte count and a varint a delta.

    The offset is a running sum over all terms, taken within first letters of terms and over their totals.
    """
    sizes = delta_encode(posted).groupBy("term").agg(F.count("*").alias("postings"), (F.sum(varint_length(F.col("delta"))) + 4).alias("bytes"))
    placed = running_sums(sizes.withColumn("all", F.lit(0)), "term", F.substring("term", 1, 3), ["all"], upto="bytes")
    return placed.select("term", "postings", "bytes", (F.col("upto") - F.col("bytes")).alias("offset"))
