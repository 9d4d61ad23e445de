"""Write-ahead logs: sequence numbers, chains, and recovery by analysis, redo and undo.

Rows: (order columns), txn_id, kind (update, commit, abort), key, old_value, new_value, and
optionally expires_at, deleted and crc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.codec import checksum

from .running import running_sums

HEADER = 49


def record_size(key: Column, old: Column, new: Column) -> Column:
    size = lambda c: F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
    return (F.lit(HEADER) + size(key) + size(old) + size(new)).cast("bigint")


def with_lsn(records: DataFrame, size: Column, order: str, part: Column) -> DataFrame:
    """Adds lsn, the bytes before a record in the order of `order`. part: a column that never falls
    along the order (a day, say); sums run within parts and over their totals, so no task sorts the whole log."""
    sized = records.withColumns({"_size": size, "_all": F.lit(0)})
    summed = running_sums(sized, order, part, ["_all"], lsn="_size")
    return summed.withColumn("lsn", F.col("lsn") - F.col("_size")).drop("_size", "_all")


def with_previous(records: DataFrame) -> DataFrame:
    """Adds prev_lsn: the record before it of the same transaction."""
    return records.withColumn("prev_lsn", F.lag("lsn").over(Window.partitionBy("txn_id").orderBy("lsn")))


def verified(records: DataFrame) -> DataFrame:
    """Fails at a record whose checksum is wrong."""
    ok = F.col("crc") == checksum(F.col("key"), F.col("old_value"), F.col("new_value"))
    message = F.format_string("analysis pass verification failed: CRC mismatch at LSN %d", F.col("lsn"))
    return records.where(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))


def analysis(records: DataFrame) -> DataFrame:
    """(txn_id, last_lsn) of the transactions that neither committed nor aborted."""
    ends = records.groupBy("txn_id").agg(F.max("lsn").alias("last_lsn"), F.bool_or(F.col("kind").isin("commit", "abort")).alias("ended"))
    return ends.where("NOT ended").select("txn_id", "last_lsn")


def high_water(records: DataFrame) -> DataFrame:
    """One row: the largest transaction id, from which numbering goes on, and the largest lsn of a loser."""
    losers = analysis(records).agg(F.max("last_lsn").alias("last_loser_lsn"))
    return records.agg(F.max("txn_id").alias("max_txn")).crossJoin(losers)


def redo(records: DataFrame) -> DataFrame:
    """Newest after-image of every key among committed transactions, with its lsn."""
    committed = records.where("kind = 'commit'").select("txn_id").distinct()
    updates = records.where("kind = 'update'").join(committed, "txn_id", "left_semi")
    image = [c for c in ("new_value", "expires_at", "deleted") if c in records.columns]
    last = updates.groupBy("key").agg(F.max("lsn").alias("lsn"), F.max_by(F.struct(*image), "lsn").alias("v"))
    return last.select("key", "lsn", *[F.col(f"v.{c}").alias("value" if c == "new_value" else c) for c in image])


def undo(records: DataFrame) -> DataFrame:
    """(key, lsn, value): what each key that losers wrote goes back to: the before-image of their first write.
    Going through the losers' records by falling lsn ends at the same value."""
    updates = records.where("kind = 'update'").join(analysis(records), "txn_id", "left_semi")
    first = updates.groupBy("key").agg(F.min("lsn").alias("lsn"), F.min_by(F.struct("old_value"), "lsn").alias("v"))
    return first.select("key", "lsn", F.col("v.old_value").alias("value"))
