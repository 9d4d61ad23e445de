"""Structured Streaming over logs: group commit by micro-batch, and latest live versions with TTL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Files of a growing log, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def group_commit(stream: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Appends each micro-batch as one commit. A batch that is run again overwrites its own folder, so each record lands once."""

    def commit(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def latest_versions(stream: DataFrame) -> DataFrame:
    """Changes of the latest version of each key (key, txn_id, value, live) from (key, txn_id, value, ts, ttl_seconds, deleted).

    Event time decides: a version expires ttl_seconds after its ts, when the watermark passes that moment.
    """
    out = "key string, txn_id bigint, value string, live boolean"
    state = "txn_id bigint, value string, expires_ms bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            txn, value, _ = kept.get
            kept.remove()
            yield pd.DataFrame({"key": [key[0]], "txn_id": [txn], "value": [value], "live": [False]})
            return
        best = kept.get[0] if kept.exists else -1
        newest = None
        for pdf in batches:
            row = pdf.loc[pdf["txn_id"].idxmax()]
            if row["txn_id"] > best:
                best, newest = int(row["txn_id"]), row
        if newest is None:
            return
        live = not bool(newest["deleted"])
        expires = int(newest["ts"].timestamp() * 1000 + newest["ttl_seconds"] * 1000) if newest["ttl_seconds"] > 0 else 0
        kept.update((best, newest["value"], expires))
        if live and expires:
            kept.setTimeoutTimestamp(max(expires, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "txn_id": [best], "value": [newest["value"]], "live": [live]})

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    return timed.groupBy("key").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.EventTimeTimeout)
