"""Consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIRTUAL_NODES = 64


def ring_hash(text: Column) -> Column:
    """First 4 bytes of the SHA-256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def ring_tokens(nodes: DataFrame, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(hash, node_id): `virtual` places on the ring for each node."""
    spread = nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    return spread.select(ring_hash(F.concat("node_id", F.lit("#"), F.col("i").cast("string"))).alias("hash"), "node_id")


def owners(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """(key, node_id): the node at the first place at or after the key's hash, else at the first place of all.

    The ring of hashes is cut into slices, about one for each place on it. A slice has its own
    places and the first one after it; a key joins its slice, so it looks at a place or two however many nodes there are.
    """
    bits = max(1, min(20, ring.count().bit_length()))
    slice_of = lambda h: F.shiftright(h, 32 - bits)
    held = ring.groupBy(slice_of(F.col("hash")).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("hash", "node_id"))).alias("places"))
    every = ring.sparkSession.range(1 << bits).withColumnRenamed("id", "slice").join(held, "slice", "left").withColumn("one", F.lit(1))
    first = F.get("places", 0)["node_id"]
    after = Window.partitionBy("one").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)  # 2**20 slices at most
    whole = Window.partitionBy("one").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = every.select("slice", "places", F.coalesce(F.first(first, ignorenulls=True).over(after), F.first(first, ignorenulls=True).over(whole)).alias("next"))
    hashed = keys.select("key", ring_hash(F.col("key")).alias("hash")).withColumn("slice", slice_of(F.col("hash")))
    own = F.get(F.filter(F.coalesce("places", F.array().cast("array<struct<hash:bigint,node_id:string>>")), lambda x: x["hash"] >= F.col("hash")), 0)["node_id"]
    return hashed.join(table, "slice").select("key", F.coalesce(own, "next").alias("node_id"))
