"""Version logs: rows (key, txn_id, seq, value, expires_at, deleted), possibly of several collections.

The newest version decides, whatever it is: one that is deleted or expired hides the
older ones. So rows are ranked first and filtered afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_time(moment: str | Column) -> Column:
    return F.lit(moment).cast("timestamp") if isinstance(moment, str) else moment


def alive(moment: str | Column) -> Column:
    return ~F.col("deleted") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_time(moment)))


def newest(log: DataFrame, *keys: str, upto: int | None = None) -> DataFrame:
    """Last version of every key, live or not: an aggregation with map-side combine, no sort. upto: the reader's transaction."""
    keys = keys or ("key",)
    seen = log if upto is None else log.where(F.col("txn_id") <= upto)
    rest = [c for c in log.columns if c not in keys]
    last = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("txn_id", "seq")).alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def snapshot(log: DataFrame, moment: str | Column, *keys: str, upto: int | None = None) -> DataFrame:
    """What a reader sees: the newest version of every key, if it is live."""
    return newest(log, *keys, upto=upto).where(alive(moment))


def read_key(log: DataFrame, key: str, moment: str | Column, upto: int | None = None) -> DataFrame:
    """Point read: no row if the key is unknown, deleted or expired. The filter on the key reaches the scan."""
    return snapshot(log.where(F.col("key") == key), moment, upto=upto)


def scan_prefix(log: DataFrame, prefix: str, moment: str | Column, upto: int | None = None) -> DataFrame:
    return snapshot(log.where(F.col("key").startswith(prefix)), moment, upto=upto).orderBy("key")


def scan_range(log: DataFrame, start: str, end: str, moment: str | Column, upto: int | None = None) -> DataFrame:
    """Keys from start to end, both included, ascending."""
    return snapshot(log.where(F.col("key").between(start, end)), moment, upto=upto).orderBy("key")


def compacted(log: DataFrame, moment: str | Column, *keys: str) -> DataFrame:
    """The log without versions that no later reader sees."""
    return snapshot(log, moment, *keys)


def before_images(log: DataFrame) -> DataFrame:
    """Every version with the value that it replaced."""
    w = Window.partitionBy("key").orderBy("txn_id", "seq")
    return log.withColumn("old_value", F.lag("value").over(w))


def conflicts(writes: DataFrame, log: DataFrame, read_txn: int, own_txn: int) -> DataFrame:
    """Keys of the write set (key) whose newest version is later than the reader's and not the reader's own: first committer wins."""
    later = log.where((F.col("txn_id") > read_txn) & (F.col("txn_id") != own_txn)).groupBy("key").agg(F.max("txn_id").alias("txn_id"))
    return writes.select("key").distinct().join(later, "key")


def hash_fields(log: DataFrame, name: str, moment: str | Column) -> DataFrame:
    """(field, value): all live fields of a hash, whose keys are H:name:field."""
    prefix = f"H:{name}:"
    live = scan_prefix(log, prefix, moment)
    return live.select(F.expr(f"substring(key, {len(prefix) + 1})").alias("field"), "value")


def hash_map(log: DataFrame, name: str, moment: str | Column) -> DataFrame:
    """One row: the hash as a map."""
    return hash_fields(log, name, moment).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
