"""Sets of ids, as columns of distinct ids or as bitmaps in chunks of 65,536."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions.keys import from_little_endian, little_endian


def distinct_ids(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id").distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").subtract(b.select("doc_id"))


def chunks(ids: DataFrame) -> DataFrame:
    """(high, low) of each distinct id: high the id without its last 16 bits, low these."""
    return distinct_ids(ids).select(F.shiftright("doc_id", 16).alias("high"), F.col("doc_id").bitwiseAND(65535).cast("int").alias("low"))


def from_chunks(parts: DataFrame) -> DataFrame:
    """Ids of chunk rows."""
    return parts.select((F.shiftleft(F.col("high").cast("bigint"), 16) + F.col("low")).alias("doc_id"))


def bitmaps(ids: DataFrame) -> DataFrame:
    """(bucket, bits): the set in compact form, which is also its stored form; repeats count once."""
    return ids.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets that only one side has are empty and left out."""
    both = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sides"))
    return both.where("sides = 2").drop("sides")


def size(maps: DataFrame) -> DataFrame:
    """One row: the number of ids."""
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("size"))


def serialised_chunks(ids: DataFrame) -> DataFrame:
    """(high, chunk): the bytes of each chunk: its number in 8 bytes, its length in 4 and its ascending low parts in 2 each, little-endian.
    A bitmap in one piece is the 4-byte count of its chunks and then these."""
    held = chunks(ids).groupBy("high").agg(F.sort_array(F.collect_list("low")).alias("lows"))
    digits = F.transform("lows", lambda x: F.concat(F.substring(F.lpad(F.hex(x), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(x), 4, "0"), 1, 2)))
    return held.select("high", F.concat(little_endian(F.col("high"), 8), little_endian(F.size("lows"), 4), F.unhex(F.array_join(digits, ""))).alias("chunk"))


def read_chunks(parts: DataFrame) -> DataFrame:
    """(high, low) from serialised chunks."""
    # the digits are made once and cut in one pass, as a look-up by place would copy the whole chunk for every id
    size = from_little_endian(F.substring("chunk", 9, 4), 4).cast("int") * 2
    digits = F.regexp_extract_all(F.hex(F.col("chunk").substr(F.lit(13), size)), F.lit("[0-9A-F]{4}"), F.lit(0))
    high = from_little_endian(F.substring("chunk", 1, 8), 8)
    return parts.select(high.alias("high"), F.explode(digits).alias("d")).select("high", F.conv(F.concat(F.substring("d", 3, 2), F.substring("d", 1, 2)), 16, 10).cast("int").alias("low"))
