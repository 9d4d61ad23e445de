"""Engine metrics."""

from __future__ import annotations

import threading
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class EngineMetrics(Protocol):
    """Extension point: where an engine reports what it does. kind: hit, miss, flush, compaction, begin or end."""

    def record(self, kind: str, amount: int = 0) -> None: ...


class Samples:
    """Keeps the samples of a driver process."""

    def __init__(self):
        self._held: list[tuple[str, int]] = []
        self._mutex = threading.Lock()

    def record(self, kind: str, amount: int = 0) -> None:
        with self._mutex:
            self._held.append((kind, int(amount)))

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._mutex:
            return spark.createDataFrame(list(self._held), "kind string, amount bigint")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def mean(total: Column, count: Column) -> Column:
    """Integer mean, 0 of nothing."""
    return F.coalesce(F.floor(F.try_divide(total, count)), F.lit(0)).cast("bigint")


def metrics_snapshot(samples: DataFrame) -> DataFrame:
    """One row from samples (kind, amount): hits, misses, their ratio, mean flush and compaction times, active transactions."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0))
    return samples.agg(
        n("hit").alias("hits"), n("miss").alias("misses"), ratio(n("hit"), n("hit") + n("miss")).alias("hit_ratio"),
        mean(total("flush"), n("flush")).alias("mean_flush"), mean(total("compaction"), n("compaction")).alias("mean_compaction"),
        (n("begin") - n("end")).alias("active"),
    )


def report(snapshot: DataFrame) -> DataFrame:
    """One row of text."""
    return snapshot.select(F.format_string("METRICS REPORT: cache hits %d, misses %d, hit ratio %.2f%%, active transactions %d, mean flush %d, mean compaction %d", "hits", "misses", F.col("hit_ratio") * 100, "active", "mean_flush", "mean_compaction").alias("status"))
